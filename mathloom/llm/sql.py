"""SQL for DuckDB with the results of the operators that SQL can express."""

from __future__ import annotations

from mathloom.llm import mixing


def _weight(level: str) -> str:
    known = mixing.WEIGHTS[level]
    if not known:
        return "1"
    return f"case {level} " + " ".join(f"when '{k}' then {w}" for k, w in known.items()) + " else 1 end"


def _split(out: str, source: str, parent: list[str], level: str) -> str:
    by = f"partition by {', '.join(parent)} " if parent else ""
    path = ", ".join([*parent, level])
    return f"""
{out}_w as (select *, cast({_weight(level)} as bigint) as weight from {source}),
{out}_o as (select *, coalesce(sum(cap) over ({by}order by cap / weight, {level} rows between unbounded preceding and 1 preceding), 0) as before,
    sum(weight) over ({by}order by cap / weight, {level} rows between current row and unbounded following) as open_weight from {out}_w),
{out}_f as (select *, cast(cap as hugeint) * open_weight <= (given - before) * cast(weight as hugeint) as is_full from {out}_o),
{out}_t as (select *, coalesce(sum(case when is_full then cap else 0 end) over ({by}), 0) as taken, coalesce(sum(case when is_full then 0 else weight end) over ({by}), 0) as open_sum from {out}_f),
{out} as (select {path}, cast(case when is_full then cap else ((given - taken) * weight) // greatest(open_sum, 1) end as bigint) as budget from {out}_t)"""


def mixture(documents: str = "documents") -> str:
    """CTEs that end with ``chosen``: the columns of ``documents``, the tree, tokens, copies and budget."""
    num, den = mixing.SHARE
    cap = f"cast(sum(tokens) as bigint) * {mixing.EPOCHS} as cap"
    return f"""
keyed as (select *, 'd' || translate(substr(md5(coalesce(source, '')), 1, 1), '0123456789abcdef', '0123012301230123') as domain,
    coalesce(lang, 'und') as language, coalesce(source, '') as origin,
    cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as tokens from {documents}),
leaf as (select domain, language, origin, cast(sum(tokens) as bigint) as leaf_tokens from keyed group by all),
given as (select cast(sum(tokens) as bigint) * {num} // {den} as given from keyed),
n1 as (select domain, {cap} from keyed group by all),
s1 as (select n1.*, given from n1, given),{_split("b1", "s1", [], "domain")},
n2 as (select domain, language, {cap} from keyed group by all),
s2 as (select n2.*, budget as given from n2 join b1 using (domain)),{_split("b2", "s2", ["domain"], "language")},
n3 as (select domain, language, origin, {cap} from keyed group by all),
s3 as (select n3.*, budget as given from n3 join b2 using (domain, language)),{_split("b3", "s3", ["domain", "language"], "origin")},
leaf_plan as (select *, case when leaf_tokens > 0 then budget // leaf_tokens else 0 end as whole from leaf join b3 using (domain, language, origin)),
ranked as (select *, md5(concat_ws(':', '{mixing.SEED}', cast(whole as varchar), coalesce(cast(doc_id as varchar), ''))) as epoch_rank, budget - whole * leaf_tokens as rest from keyed join leaf_plan using (domain, language, origin)),
running as (select *, sum(tokens) over (partition by domain, language, origin order by epoch_rank) as upto from ranked),
chosen as (select *, whole + case when rest > 0 and upto <= rest then 1 else 0 end as copies from running)"""


def near_duplicates(documents: str = "documents") -> str:
    """Rows of the Jaccard join, for documents whose doc_ids differ."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as ws from {documents}),
sh as (select distinct doc_id, unnest(case when len(ws) = 1 then ws else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as s from w),
n as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b using (s) where a.doc_id < b.doc_id group by all),
half as (select x, y from pairs join n as nx on nx.doc_id = x join n as ny on ny.doc_id = y where 100 * c >= 60 * (nx.n + ny.n - c)),
links as (select x, y from half union all select y, x from half),
reach(doc_id, other) as (select doc_id, doc_id from {documents} union select doc_id, y from reach join links on other = x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(l.n, 0) as n_similar, r.component_id
from {documents} d left join n using (doc_id) left join (select x as doc_id, count(*) as n from links group by x) l using (doc_id)
join (select doc_id, min(other) as component_id from reach group by doc_id) r using (doc_id)"""


def sharded(documents: str = "documents", shards: int = 8) -> str:
    """Rows of the sharding. Every capacity from the smallest thinkable to one largest group
    more is tried, all greedily; crc32 goes over the bytes."""
    steps = "".join(
        f"""
p{j} as (select cap, coalesce(e{j}.upto, p{j - 1}.pos) as pos from p{j - 1} asof left join ends e{j} on p{j - 1}.pos + p{j - 1}.cap >= e{j}.upto),"""
        for j in range(1, shards + 1)
    )
    cut = " union all ".join(f"select pos from p{j} where cap = (select cap from best)" for j in range(1, shards))
    return f"""with recursive slow(i, k, v) as (select range, 0, range::bigint from range(256)
    union all select i, k + 1, case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from slow where k < 8),
crc_table as (select list(v order by i) as t from slow where k = 8),
d as (select doc_id, coalesce(text, '') as text, strlen(coalesce(text, '')) + 1 as size, md5(coalesce(text, '')) as key from {documents}),
crc as (select key, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32 from (select distinct key, text from d), crc_table),
groups as (select key, sum(size)::bigint as size from d group by key),
ends as (select key, sum(size) over (order by key)::bigint as upto, size from groups),
total as (select sum(size)::bigint as total, max(size) as most from groups),
low as (select greatest(most, (total + {shards - 1}) // {shards}) as low, most, total from total),
p0 as (select unnest(range(low, low + most + 1)) as cap, 0::bigint as pos from low),{steps}
best as (select min(cap) as cap from p{shards}, total where pos >= total),
cuts as ({cut}),
placed as (select d.doc_id, d.size, d.key, (select count(*) from cuts where cuts.pos < ends.upto) as shard from d join ends using (key)),
cells as (select greatest(1, count(*) // ({shards} * 20000)) as cells from d),
told as (select placed.*, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || key), 1, 12))::bigint % cells as cell from placed, cells)
select doc_id, size::bigint as size, text_crc32, 'bytes' as law, shard::int as shard, row_number() over (partition by shard order by cell, doc_id nulls first, key) - 1 as slot, null::int as grown_shard
from told join crc using (key)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mixing": f"with {mixture()} select doc_id, domain, language, origin, tokens, cast(copies as bigint) as copies, budget as leaf_budget from chosen where copies > 0",
        "op7_ngram_jaccard_join": near_duplicates(),
        "op10_sharding": sharded(),
    }
