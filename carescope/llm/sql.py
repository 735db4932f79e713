"""DuckDB twins of the operators that SQL can express."""

from __future__ import annotations

#: Page roles: SHA-1 as base32 (five bits a character, read from two hex digits), first page by least id.
WARC = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as payload_bytes, sha1(h) as x from p),
f as (select x, payload_bytes, min(page_id) as m from d group by all)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(((('0x' || substr(x, cast(5 * i // 4 as int) + 1, 2))::bigint >> cast(3 - 5 * i % 4 as int)) & 31) + 1 as int), 1)), '') as payload_digest,
  case when page_id = m then 'response' else 'revisit' end as record_type,
  case when page_id <> m then m end as refers_to
from d join f using (x, payload_bytes)"""


def sharding_sql(shards: int = 16, seed: int = 20_240_601, rounds: int = 8) -> str:
    """Row numbers by id, the Feistel rounds as nested selects, cycle walking as a recursion."""
    prime, factor = 2_147_483_647, 48_271

    def once(source: str) -> str:
        key, out = seed % (prime - 1) + 1, f"select rn, a, b, n, x // b as l, x % b as r from ({source})"
        for k in range(rounds):
            key = key * factor % prime
            half, side, size = ("r", "l", "a") if k % 2 == 0 else ("l", "r", "b")
            t = f"(({half} % {prime} * {factor} + {key}) % {prime})"
            mix = f"({t} * ({t} % 65536 + 1) % {prime})"
            out = f"select * replace (({side} + {mix} % {size}) % {size} as {side}) from ({out})"
        return f"select rn, a, b, n, l * b + r as x from ({out})"
    return f"""
with recursive bits as (select k, k as v, 0 as step from range(256) t(k)
  union all select k, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, step + 1 from bits where step < 8),
crc as (select k, v as t from bits where step = 8),
tab as (select list(t order by k) as tt from crc),
d as (select doc_id, coalesce(text, '') as t from documents),
h as (select doc_id, strlen(t) + 1 as size, hex(encode(t)) as hx from d),
c as (select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint,
        list_transform(range(1, size), lambda i: ('0x' || substr(hx, cast(2 * i - 1 as int), 2))::bigint)),
        lambda s, y: xor(s >> 8, tt[cast(xor(s & 255, y) + 1 as int)])), 4294967295::bigint) as text_crc32 from h, tab),
g as (select row_number() over (order by doc_id, text_crc32, size) - 1 as rn, count(*) over () as n, * from c),
s as (select rn, n, cast(ceil(sqrt(n)) as bigint) as b, cast(ceil(n / ceil(sqrt(n))) as bigint) as a, rn as x from g),
walk as ({once("select * from s")}
  union all {once("select * from walk where x >= n")})
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'rows' as law, cast(x % {shards} as int) as shard,
  cast(x // {shards} as bigint) as slot, cast(null as int) as grown_shard, cast(rn as bigint) as row_number
from walk join g using (rn) where x < walk.n"""


#: All phrases of one to five words by unnesting, all cuts by join, containment by unnested parts.
COLLOCATIONS = r"""
with p as (select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
totals as (select lang, sum(len(ws))::bigint as n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
  from w, range(1, 6) t(k)),
f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 100),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k > 1),
cut as (select lang, phrase, a, c.k as size, ws, j, array_to_string(ws[1:j], ' ') as lp, array_to_string(ws[j + 1:], ' ') as rp
  from c, range(1, 5) t(j) where j < c.k),
scored as (select cut.lang, cut.phrase, a, size, j, x.f as l, y.f as r, n,
    (1000::hugeint * a * n) // (x.f::hugeint * y.f) as score
  from cut join f x on x.lang = cut.lang and x.phrase = lp join f y on y.lang = cut.lang and y.phrase = rp
  join totals on totals.lang = cut.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, max(a) as longer
  from c, range(2, 5) s(m), range(1, 5) t(i) where m < k and i + m - 1 <= k group by all),
kept as (select best.* from best left join inside using (lang, phrase) where longer is null or 100 * longer < 100 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from kept qualify rank <= 2000"""

#: The rebuilt turns by windows and joins, nodes as prefixes of the joined digests, subtrees by unnested prefixes.
PREFIX_TRIE = """
with recursive bits as (select k, k as v, 0 as step from range(256) t(k)
  union all select k, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, step + 1 from bits where step < 8),
tab as (select list(v order by k) as tt from bits where step = 8),
raw as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
dig as (select conv_id, turn, left(sha256(length(role) || ':' || role || text), 32) as digest, length(text) as chars from raw),
t as (select conv_id, digest, chars, row_number() over (partition by conv_id order by turn nulls first, digest) - 1 as pos from dig),
ids as (select conv_id, count(*) as size, hex(encode(conv_id::varchar)) as hx from t group by conv_id),
hashed as (select conv_id, size, conv_id - conv_id % 100 as base, xor(list_reduce(list_prepend(4294967295::bigint,
    list_transform(range(1, len(hx) // 2 + 1), lambda i: ('0x' || substr(hx, cast(2 * i - 1 as int), 2))::bigint)),
    lambda s, y: xor(s >> 8, tt[cast(xor(s & 255, y) + 1 as int)])), 4294967295::bigint) % 6 as h from ids, tab),
c as (select a.conv_id, a.base, a.h, least(a.h, coalesce(b.size, 0)) as taken from hashed a left join ids b on b.conv_id = a.base),
r as (select conv_id, pos - h + taken as pos, digest, chars from t join c using (conv_id) where pos >= h
  union all select c.conv_id, t.pos, t.digest, t.chars from c join t on t.conv_id = c.base where t.pos < c.taken),
p as (select c.conv_id, coalesce(string_agg(digest, '' order by pos), '') as key, list_prepend(0, coalesce(list(chars order by pos) filter (digest is not null), [])) as chars
  from c left join r using (conv_id) group by c.conv_id),
m as (select conv_id, d, left(key, cast(32 * d as int)) as k, chars[cast(d + 1 as int)] as last, d = len(key) // 32 as ended
  from (select *, unnest(range(0, len(key) // 32 + 1)) as d from p)),
n as (select k, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(last) as last,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ended), '')) as ends_sha256 from m group by k, d),
ch as (select left(k, cast(32 * (d - 1) as int)) as k, count(*) as n_children from n where d > 0 group by all),
nn as (select n.*, coalesce(n_children, 0) as n_children from n left join ch using (k)),
s as (select left(k, cast(32 * j as int)) as k, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * last) as saved_tokens
  from (select *, unnest(range(0, d + 1)) as j from nn) group by 1)
select nn.conv_id, nn.d::bigint as depth, up.conv_id as parent_conv_id, nn.n_convs::bigint as n_convs, nn.n_children::bigint as n_children,
  s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, nn.ends_sha256
from nn join s using (k) left join nn up on nn.d > 0 and up.k = left(nn.k, cast(32 * (nn.d - 1) as int))"""

SQL = {"op1_sharding": sharding_sql(), "op9_warc": WARC, "op11_prefix_trie": PREFIX_TRIE, "op12_collocations": COLLOCATIONS}
