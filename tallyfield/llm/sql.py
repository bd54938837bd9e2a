"""DuckDB twins of the registered queries that SQL can express on whole tables."""

ORACLES: dict[str, str] = {}

ORACLES["op5_sharding"] = r"""
with recursive crc_table as (  -- the 256 remainders of the reflected CRC-32 polynomial
  select i, 0 as step, i::ubigint as v from range(256) t(i)
  union all
  select i, step + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end
  from crc_table where step < 8
),
crc as (select list(v order by i) as t from crc_table where step = 8),
sized as (
  select doc_id, coalesce(strlen(text), 0) + 1 as size,
    xor(list_reduce(
      list_concat([4294967295::ubigint],
        [('0x' || hex(encode(coalesce(text, '')))[2 * k + 1 : 2 * k + 2])::ubigint
         for k in range(coalesce(strlen(text), 0)::int)]),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::int + 1])), 4294967295::ubigint)::bigint as text_crc32
  from documents, crc
),
summed as (
  select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding) as e,
    sum(size) over () as total
  from sized
),
placed as (select *, (((2 * e - size) * 8) // (2 * total))::int as shard from summed)
select doc_id, size, text_crc32, 'bytes' as law, shard,
  row_number() over (partition by shard order by e) - 1 as slot, null::int as grown_shard
from placed
"""

ORACLES["op10_mixing"] = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    md5('mix-1:' || doc_id) as place
  from documents
),
sources as (
  select source, sum(size)::bigint as source_size, 2 * sum(size)::bigint as cap,
    [3, 1, 2][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int] as weight
  from sized group by source
),
leveled as (
  select *, cap / weight as ratio,
    (1.5 * sum(source_size) over () - coalesce(sum(cap) over before, 0))
      / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from sources
  window before as (order by cap / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding)
),
level as (select max(level) as level from leveled where level <= ratio),
targets as (
  select source, source_size, least(cap::double, coalesce((select level from level) * weight, cap)) as target
  from leveled
),
queue as (
  select s.*, source_size, target,
    coalesce(sum(size) over (partition by s.source order by
      ('0x' || place[1:8])::bigint % 1024, place, size rows between unbounded preceding and 1 preceding), 0) as before
  from sized s join targets t on s.source is not distinct from t.source
),
entries as (
  select *, (source_size * copy + before + size) / target as finish
  from queue, (values (0), (1)) c(copy) where size > 0
),
run as (
  select *, sum(size) over (order by finish, place, copy rows unbounded preceding) as e from entries
),
taken as (
  select doc_id, sum(size) as taken from run
  where e <= 1.5 * (select sum(size) from sized) group by doc_id
)
select q.doc_id, q.size::bigint as size, q.source_size, q.target, coalesce(t.taken, 0)::bigint as taken
from queue q left join taken t on q.doc_id = t.doc_id
"""

ORACLES["op11_lexical"] = r"""
with words as (
  select row_number() over () as row, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as terms
  from documents where text is not null
),
sizes as (select row, doc_id, len(terms)::bigint as n, terms from words where len(terms) > 0),
whole as (select count(*)::bigint as docs, sum(n)::bigint as length from sizes),
tf as (select row, term, count(*)::bigint as tf from (select row, unnest(terms) as term from sizes) group by all),
df as (select term, count(*) as df from tf group by term),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from df, whole),
items as (
  select item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term
  from (select distinct item_id, text from benchmark)
),
asked as (select item_id, term, count(*) as times from items group by all),
scored as (
  select item_id, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::bigint as score
  from asked join weights using (term) join tf using (term) join sizes using (row), whole
  group by item_id, row, doc_id
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls first)::int as rank, doc_id, score
from scored where score > 0
qualify rank <= 10
"""

ORACLES["op12_decontaminate"] = r"""
with docs as (
  select row_number() over () as row, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as words
  from documents
),
items as (
  select item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark where text is not null
),
windows as (
  select distinct item_id, width, array_to_string(words[k : k + width - 1], ' ') as run
  from (
    select item_id, words, least(10, len(words)) as width, unnest(range(1, len(words) - least(10, len(words)) + 2)) as k
    from items where len(words) > 0
  )
),
runs as (
  select row, k, width, array_to_string(words[k : k + width - 1], ' ') as run
  from (
    select row, words, width, unnest(range(1, len(words) - width + 2)) as k
    from docs, (select distinct width from windows) where len(words) >= width
  )
),
found as (select row, k, width, item_id from runs join windows using (width, run)),
hit as (select row, count(distinct place) as n_hit from (select row, unnest(range(k, k + width)) as place from found) group by row),
named as (
  select row, count(*) as n_items, string_agg(item, ',' order by encode(item)) as names
  from (select distinct row, item_id::varchar as item from found where item_id is not null) group by row
)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (row) left join named using (row)
"""

ORACLES["op13_prefix_trie"] = r"""
with recursive crc_table as (  -- the 256 remainders of the reflected CRC-32 polynomial
  select i, 0 as step, i::ubigint as v from range(256) t(i)
  union all
  select i, step + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end
  from crc_table where step < 8
),
crc as (select list(v order by i) as t from crc_table where step = 8),
convs as (
  select conv_id, list(md5(coalesce(role, '')) || md5(coalesce(text, '')) order by turn nulls first, role, text) as turns,
    list(strlen(coalesce(text, ''))::bigint order by turn nulls first, role, text) as sizes
  from conversations where conv_id is not null group by conv_id
),
heads as (
  select c.*, (xor(list_reduce(
      list_concat([4294967295::ubigint], [ascii(d)::ubigint for d in string_split(conv_id::varchar, '')]),
      lambda r, b: xor(r >> 8, t[(xor(r, b) & 255)::int + 1])), 4294967295::ubigint) % 9)::bigint as h
  from convs c, crc
),
rebuilt as (
  select c.conv_id, list_concat(coalesce(b.turns[1 : c.h], []), c.turns[c.h + 1 :]) as turns,
    list_concat(coalesce(b.sizes[1 : c.h], []), c.sizes[c.h + 1 :]) as sizes
  from heads c left join convs b on b.conv_id = c.conv_id - c.conv_id % 5
),
paths as (
  select conv_id, d as depth, len(turns) as length, md5(array_to_string(turns[1 : d], '')) || d as node,
    case when d > 0 then md5(array_to_string(turns[1 : d - 1], '')) || (d - 1) end as parent,
    case when d > 0 then sizes[d] else 0 end as size
  from (select conv_id, turns, sizes, unnest(range(len(turns) + 1)) as d from rebuilt)
),
nodes as (
  select node, any_value(parent) as parent, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs,
    any_value(size) as size, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where length = depth), '')) as ends_sha256
  from paths group by node
),
children as (select parent as node, count(*) as n_children from nodes where parent is not null group by parent),
full_nodes as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (node)),
below as (
  select p.node, count(*) filter (where f.n_children = 0) as n_leaves, sum((f.n_convs - 1) * f.size) as saved_tokens
  from full_nodes f join paths p on p.conv_id = f.conv_id and p.depth <= f.depth group by p.node
)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens::bigint as saved_tokens, f.ends_sha256
from full_nodes f join below using (node) left join full_nodes p on p.node = f.parent
"""
