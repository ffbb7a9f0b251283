"""The queries of this subpackage, each over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from spindrift.llm import bpe, counts, grammar, lines, media, merkle, neardup, packing, quality, repair, toxicity, urls, winnow
from spindrift.llm.shared import tokenizer_path

WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_chunks(spark, sf_dir):
    return bpe.digests(_docs(spark, sf_dir), tokenizer_path(WORD_BPE))


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op2_quality_attention(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return quality.score(docs, quality.train(docs, _labels(spark, sf_dir)))


def op3_media_png(spark, sf_dir):
    return media.digests(_docs(spark, sf_dir))


def op4_pack_squares(spark, sf_dir):
    return packing.pack(_docs(spark, sf_dir), tokenizer_path(BYTE_BPE))


def op5_lines_cuckoo(spark, sf_dir):
    return lines.digests(_docs(spark, sf_dir))


def op6_ids_repair(spark, sf_dir):
    return grammar.read(grammar.write(_docs(spark, sf_dir), tokenizer_path(BYTE_BPE)))


def op7_toxicity_zstd(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def op8_neardup_icws(spark, sf_dir):
    return neardup.classes(_docs(spark, sf_dir))


def op9_urls_as_of(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.active(urls.sample_captures(pages), urls.sample_log(pages))


def op10_winnowing(spark, sf_dir):
    return winnow.edited(_docs(spark, sf_dir))


def op11_merkle_duckdb(spark, sf_dir):
    return merkle.manifest(_docs(spark, sf_dir))


def op12_repair_lazy(spark, sf_dir):
    return repair.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_prefix_counts(spark, sf_dir):
    return counts.limits(counts.table(_docs(spark, sf_dir), tokenizer_path(PIECE_BPE)))


QUERIES = {f.__name__: f for f in (op1_bpe_chunks, op2_quality_attention, op3_media_png, op4_pack_squares, op5_lines_cuckoo, op6_ids_repair, op7_toxicity_zstd, op8_neardup_icws, op9_urls_as_of, op10_winnowing, op11_merkle_duckdb, op12_repair_lazy, op13_prefix_counts)}
_LINES_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, i, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as s
  from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from d)),
k as (select doc_id, i, line, case when length(s) >= 40 then translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end as key from l),
f as (select key, max(doc_id) as keeper from k where key is not null group by key having count(distinct doc_id) >= 5)
select doc_id, count(*)::bigint as n_lines, count_if(coalesce(doc_id < keeper, false))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not coalesce(doc_id < keeper, false)), '')) as kept_sha256
from k left join f using (key) group by doc_id
"""

_URLS_SQL = r"""
with parsed as (select page_id, url, nullif(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[wW]{3}\.)?(\[[^\]/?#@]*\]|[^/?#:@\[]+)(?::\d*)?(/[^?#]*)?', 1)), '') as host,
    regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[wW]{3}\.)?(\[[^\]/?#@]*\]|[^/?#:@\[]+)(?::\d*)?(/[^?#]*)?', 2) as path,
    timestamp '2024-01-01' + to_days(cast((page_id * 37) % 365 as int)) + to_seconds(page_id % 86400) as fetched_at from pages),
keyed as (select page_id, fetched_at, unnest(list_distinct(list_concat(
      list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: 'd:' || array_to_string(string_split(host, '.')[i:], '.')),
      ['u:' || host || path, 'u:' || host || regexp_extract(path, '^/[^/]*', 0)]))) as key from parsed where host is not null),
m as (select distinct key, md5(key) as m from keyed where ascii(substr(md5(key), 1, 1)) % 2 = 0),
e as (select key, ['adult', 'malware', 'spam'][ascii(substr(m, 7, 1)) % 3 + 1] as list, (ascii(substr(m, 2, 1)) * 3 + ascii(substr(m, 3, 1))) % 300 as since,
    (ascii(substr(m, 2, 1)) * 3 + ascii(substr(m, 3, 1))) % 300 + (ascii(substr(m, 4, 1)) * 7) % 90 + 1 as until, ascii(substr(m, 5, 1)) % 2 = 0 as gone, ascii(substr(m, 6, 1)) % 3 = 0 as back from m),
iv as (select list, key, timestamp '2024-01-01' + to_days(cast(since as int)) as since, case when gone then timestamp '2024-01-01' + to_days(cast(until as int)) end as until from e
  union all select list, key, timestamp '2024-01-01' + to_days(cast(until + 20 as int)), null from e where gone and back),
hit as (select k.page_id, iv.list, k.key from keyed k join iv on k.key = iv.key and k.fetched_at >= iv.since and (iv.until is null or k.fetched_at < iv.until))
select p.page_id, p.host, count(hit.list)::bigint as n_active, coalesce(string_agg(distinct hit.list, ',' order by hit.list), '') as lists, min(hit.key) as first_key, count(hit.list) > 0 as blocked
from parsed p left join hit using (page_id) group by p.page_id, p.host
"""

#: crc32 of ASCII text ``k``, for a row joined with crc_table.
_CRC_TABLE = "crc_table as (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crcs)"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::bigint)), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"

_MERKLE_SQL = (
    "with recursive " + _CRC_TABLE + r""",
l as (select *, coalesce('+' || lang, '') as tree, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as up,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
    coalesce(doc_id::varchar, 'x') as k from documents),
leaf as (select doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when doc_id is not null and """ + _CRC + r""" % 3 = 0 then sha256(head || coalesce(strlen(text) || ':' || translate(text, up, lower(up)), '-')) else sha256(head || coalesce(strlen(text) || ':' || text, '-')) end as other from l, crc_table),
base as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by tree) as n from leaf),
node as (select 0 as level, tree, place, n, leaf as h from base
  union all select level + 1, tree, place // 8, (n + 7) // 8, sha256(string_agg(h, '' order by place)) from node where n > 1 group by level, tree, place // 8, n),
subroot as (select tree, h as subroot, row_number() over (order by tree) - 1 as place, count(*) over () as n, level as height from node where n = 1),
outer_node as (select 0 as level, place, n, subroot as h from subroot
  union all select level + 1, place // 8, (n + 7) // 8, sha256(string_agg(h, '' order by place)) from outer_node where n > 1 group by level, place // 8, n),
top as (select h as root, level as outer_height from outer_node where n = 1),
run as (select level, tree, place // 8 as run, string_agg(h, '' order by place) as hs from node where n > 1 group by all),
outer_run as (select level, place // 8 as run, string_agg(h, '' order by place) as hs from outer_node where n > 1 group by all),
fold as (select tree, place as doc, 0 as level, place, other as h, '' as proof from base
  union all select f.tree, f.doc, f.level + 1, f.place // 8, sha256(substr(hs, 1, 64 * (f.place % 8)) || f.h || substr(hs, 64 * (f.place % 8) + 65)), proof || substr(hs, 1, 64 * (f.place % 8)) || substr(hs, 64 * (f.place % 8) + 65)
  from fold f join run r on f.tree = r.tree and f.level = r.level and f.place // 8 = r.run),
outer_fold as (select f.tree, doc, 0 as level, s.place, f.h, proof from fold f join subroot s on f.tree = s.tree and f.level = s.height
  union all select f.tree, f.doc, f.level + 1, f.place // 8, sha256(substr(hs, 1, 64 * (f.place % 8)) || f.h || substr(hs, 64 * (f.place % 8) + 65)), proof || substr(hs, 1, 64 * (f.place % 8)) || substr(hs, 64 * (f.place % 8) + 65)
  from outer_fold f join outer_run r on f.level = r.level and f.place // 8 = r.run)
select b.doc_id, b.leaf, s.subroot, root, sha256(f.proof) as proof_sha256, f.h as folded_root, f.h = root as verified
from base b join subroot s using (tree) cross join top join outer_fold f on f.tree = b.tree and f.doc = b.place and f.level = outer_height
"""
)

_REPAIR_SQL = (
    "with recursive " + _CRC_TABLE + r""",
given as (select coalesce(conv_id::varchar, ' ') as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
hit as (select conv, turn, role, text, """ + _CRC + r""" % 20 as kind from given, crc_table),
hurt as (select conv, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when kind = 3 then [1, 2] else [1] end) as copy from hit where kind != 0),
r as (select *, row_number() over (partition by conv order by turn nulls first, role, sha256(strlen(role) || ':' || role || text), copy) as i, count(*) over (partition by conv) as n,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from hurt),
f as (select conv, turn, role, text, i, n, substr(role, 1, 1) as l,
    case when bare = '' then 'blank' when row_number() over (partition by conv, role, text order by i) > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(substr(role, 1, 1)) over (partition by conv order by i) || substr(role, 1, 1) as pair from r),
g as (select *, fault in ('', 'truncated') as live, case when fault = 'truncated' then 3 else 0 end as m from f),
v as (select conv, n + 1 as i, [0, 6, 3, 0] as v from r where i = 1
  union all select conv, i, [least(b0, 3 + c2), least(b1, 3 + c2), c2, least(b3, 3 + b2)] from (select *, least(b2, 3 + b3) as c2 from (select v.conv, g.i,
    least(4 + v[1], case when live then 3 + m + v[3] end, case when live and l = 'u' then m + v[3] end, case when live and l = 's' then m + v[2] end) as b0,
    least(4 + v[2], case when live then 3 + m + v[3] end, case when live and l = 'u' then m + v[3] end) as b1,
    least(4 + v[3], case when live then 3 + m + v[4] end, case when live and l = 'a' then m + v[4] end) as b2,
    least(4 + v[4], case when live then 3 + m + v[3] end, case when live and l = 'u' then m + v[3] end) as b3
    from v join g on v.conv = g.conv and g.i = v.i - 1))),
s as (select v.conv, v.i, v.v as here, w.v as next, g.role, g.text, l, live, m, n from v left join v w on v.conv = w.conv and w.i = v.i + 1 left join g on g.conv = v.conv and g.i = v.i),
t as (select conv, 1::bigint as i, 0 as q, '' as audit, [] :: varchar[] as lines, here[1] as cost from s where i = 1
  union all select conv, case when e = 'I' then i else i + 1 end, case e when 'D' then q when 'K' then kept else fill end, audit || e,
    case e when 'D' then lines when 'K' then lines || [role || ':' || text] when 'I' then lines || [filler || ':'] else lines || [filler || ':' || text] end, cost
  from (select *, case when here[q + 1] = 4 + next[q + 1] then 'D' when here[q + 1] = 3 + here[fill + 1] then 'I' when live and kept is not null and here[q + 1] = m + next[kept + 1] then 'K' else 'R' end as e
    from (select t.*, here, next, role, text, live, m, case q when 2 then 3 else 2 end as fill, case q when 2 then 'assistant' else 'user' end as filler,
        case when l = 's' and q = 0 then 1 when l = 'u' and q != 2 then 2 when l = 'a' and q = 2 then 3 end as kept
      from t join s on t.conv = s.conv and t.i = s.i where next is not null or q in (1, 2)))),
done as (select conv, arg_max(audit, length(audit)) as audit, arg_max(lines, length(audit)) as lines, any_value(cost) as cost from t group by conv),
stats as (select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate, count_if(fault = 'truncated') as truncated,
    count_if(pair is not null and pair not in ('su', 'ua', 'au')) as illegal from f group by conv)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join stats on coalesce(c.conv_id::varchar, ' ') = stats.conv left join done using (conv)
"""
)

ORACLES: dict[str, str] = {"op9_urls_as_of": _URLS_SQL, "op5_lines_cuckoo": _LINES_SQL, "op11_merkle_duckdb": _MERKLE_SQL, "op12_repair_lazy": _REPAIR_SQL}
