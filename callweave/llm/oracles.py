"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from callweave.llm import chat, quality, url_filter

WS = "\\x20\\x09-\\x0D"


def quality_sql(docs: str = "documents", keys: str = "doc_id", tail: str = "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from judged") -> str:
    """Restates the measures, the bucketed quantiles and the rules over a table or subquery ``docs``."""
    names = ["symbols", "duplicates", "repeats", "capitals"]
    levels, spreads = (" ".join(f"when '{n}' then {v[i]}" for n, v in quality.FENCES.items()) for i in (0, 1))
    pick = ", ".join(f"max(case when g.measure = '{n}' then case when g.total >= {quality.MIN_GROUP} then least(g.top, {quality.ROOF} * l.top) else l.top end end) as top_{n}" for n in names)
    within = " and ".join(f"v.{n} <= t.top_{n}" for n in names)
    return f"""
with raw as (
    select row_number() over () as rid, *, coalesce("text", '') as tx from {docs}
), worded as (
    select *, list_filter(string_split_regex(tx, '[{WS}]'), lambda x: x <> '') as ws,
        list_filter(string_split(tx, chr(10)), lambda x: regexp_matches(x, '[^{WS}]')) as ls
    from raw
), windows as (
    select rid, p, array_to_string(ws[p:p + 7], ' ') as w from (select rid, ws, unnest(range(1, len(ws) - 6)) as p from worded)
), again as (
    select rid, p from windows qualify count(*) over (partition by rid, w) > 1
), repeated as (
    select rid, count(distinct p + k) as n from again, range(8) as r(k) group by rid
), measured as (
    select w.*, len(ws)::bigint as n_words, len(ls)::bigint as n_lines, length(regexp_replace(tx, '[{WS}]', '', 'g'))::bigint as word_chars,
        (length(tx) - length(regexp_replace(tx, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        length(regexp_replace(tx, '\\P{{Lu}}', '', 'g'))::bigint as n_capitals,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
    from worded w left join repeated r using (rid)
), valued as (
    select *, case when word_chars > 0 then 1000 * n_symbols // word_chars else 0 end as symbols,
        case when n_lines > 0 then 1000 * n_dup_lines // n_lines else 0 end as duplicates,
        case when n_words > 0 then 1000 * n_repeat_words // n_words else 0 end as repeats,
        case when word_chars > 0 then 1000 * n_capitals // word_chars else 0 end as capitals
    from measured
), long as (
    {" union all ".join(f"select lang, source, '{n}' as measure, {n} as v from valued" for n in names)}
), cells as (
    select lang, source, measure, case when v < 64 then v else (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) end as b, count(*) as n from long group by all
), levels as (
    select 2 as level, * from cells
    union all select 1, lang, null, measure, b, sum(n) from cells group by lang, measure, b
    union all select 0, null, null, measure, b, sum(n) from cells group by measure, b
), ranked as (
    select *, sum(n) over (partition by level, lang, source, measure order by b rows unbounded preceding) as upto,
        sum(n) over (partition by level, lang, source, measure) as total from levels
), fences as (
    select level, lang, source, measure, max(total) as total,
        min(case when 2 * upto >= total then b end) as q50, min(case when 1000 * upto >= total * case measure {levels} end then b end) as tail
    from ranked group by level, lang, source, measure
), tops as (
    select *, tail + ((tail - q50) * case measure {spreads} end) // 4 + {quality.STEP} as top from fences
), languages as (
    select l.lang, l.measure, case when l.total >= {quality.MIN_GROUP} then least(l.top, {quality.ROOF} * a.top) else a.top end as top
    from tops l join tops a on a.level = 0 and l.measure = a.measure where l.level = 1
), picked as (
    select g.lang, g.source, {pick} from tops g join languages l on g.lang is not distinct from l.lang and g.measure = l.measure
    where g.level = 2 group by g.lang, g.source
), judged as (
    select v.*, base_failed, not base_failed and {within} as kept
    from (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from valued) v
    join picked t on v.lang is not distinct from t.lang and v.source is not distinct from t.source
)
{tail}"""


def _rest(url: str) -> str:
    return f"(case when instr({url}, '://') > 0 then substr({url}, instr({url}, '://') + 3) else '' end)"


def _host(url: str) -> str:
    return f"coalesce(translate(regexp_extract({_rest(url)}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({_rest(url)}, '^[^/?#]*([^?#]*)', 1), '')"


def _node(url: str) -> str:
    port = f"case lower(split_part({url}, '://', 1)) when 'http' then ':80$' when 'https' then ':443$' else '^$' end"
    parts = f"string_split({_path(url)}, '/')[2:]"
    # a path's segments one after the other: . is left out, .. takes the one before
    walked = f"list_reduce(list_transform({parts}, lambda x: [x]), lambda done, x: case when x[1] = '.' then done when x[1] = '..' then done[:greatest(len(done) - 1, 0)] else done || x end, []::varchar[])"
    clean = f"case when regexp_matches({_path(url)}, '/[.][.]?(/|$)') then '/' || array_to_string({walked} || case when regexp_matches({_path(url)}, '/[.][.]?$') then [''] else [] end, '/') else {_path(url)} end"
    return f"(case when {_host(url)} <> '' then regexp_replace({_host(url)}, {port}, '') || {clean} || regexp_extract({_rest(url)}, '^[^?#]*([^#]*)', 1) end)"


def url_filter_sql() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in url_filter.RULES)
    entities = ", ".join("'{}': '{}'".format(k, v.replace("'", "''")) for k, v in url_filter.ENTITIES.items())
    best = lambda source: f"(select arg_max({{'rule': r.rule, 'verdict': r.verdict}}, (length(r.rule), r.verdict = 'allow', r.rule)) from rules r where ({source}.host = r.host or {source}.host like '%.' || r.host) and starts_with({source}.path, r.path))"
    value = """("[^"]*"|''[^'']*''|[^\\s>]+)"""
    attribute = lambda tag, name: f"""trim(regexp_extract({tag}, '(?i)\\b{name}\\s*=\\s*{value}', 1), '"''')"""
    first = lambda text: f"""regexp_extract({text}, '^([^"''\\s>]*)', 1)"""
    number = "case when starts_with(lower(x), '&#x') then try_cast('0x' || x[4:-2] as bigint) else try_cast(x[3:-2] as bigint) end"
    return f"""
with recursive rules(verdict, rule, host, path) as (values {rules}),
tags as (
    select url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) as tag from pages
), links as (
    select url, case when starts_with(lower(tag), '<link') then
            case when list_contains(regexp_split_to_array(rtrim(lower({attribute("tag", "rel")}), '/'), '\\s+'), 'canonical') then {first(attribute("tag", "href"))} end
        when lower({attribute("tag", "http-equiv")}) = 'refresh' then regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) end as written
    from tags
), read as (
    select url, array_to_string(list_transform(regexp_extract_all(written, '(&#?[0-9A-Za-z]+;|[^&]+|&)'), lambda x:
        case when starts_with(x, '&#') and len(x) > 3 and ({number}) between 1 and 1114111 and ({number}) not between 55296 and 57343 then chr(({number})::int)
            else coalesce(map {{{entities}}}[regexp_extract(x, '^&([A-Za-z]+);$', 1)], x) end), '') as link
    from links where written <> ''
), absolute as (
    select url, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link
        when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
        when starts_with(link, '//') then regexp_extract(url, '^([^:/?#]*)://', 1) || ':' || link
        when starts_with(link, '/') then regexp_extract(url, '^([^:/?#]*)://', 1) || '://' || {_host("url")} || link
        when regexp_matches(link, '^[?#]') then regexp_extract(url, '^([^:/?#]*)://', 1) || '://' || {_host("url")} || {_path("url")} || link
        else regexp_extract(url, '^([^:/?#]*)://', 1) || '://' || {_host("url")} || regexp_replace(case when {_path("url")} = '' then '/' else {_path("url")} end, '[^/]*$', '') || link end as target
    from read
), edges as (
    select {_node("url")} as a, {_node("target")} as b from absolute
), pairs as (
    select a, b from edges where a is not null and b is not null union select b, a from edges where a is not null and b is not null
), reach(node, other) as (
    select a, a from pairs union select r.node, b.b from reach r join pairs b on r.other = b.a
), parts as (
    select other, regexp_extract(other, '^([^/?#]*)', 1) as host, regexp_extract(other, '^[^/?#]*([^?#]*)', 1) as path from (select distinct other from reach)
), votes as (
    select r.node, bool_or(v.verdict = 'allow') as allowed, bool_or(v.verdict = 'block') as blocked
    from reach r join (select p.other, {best("p")}.verdict as verdict from parts p) v on r.other = v.other group by r.node
), said as (
    select node, case when allowed then 'allow' when blocked then 'block' end as component_verdict from votes
), plain as (
    select page_id, {_host("url")} as host, {_path("url")} as path, {_node("url")} as node from pages
), judged as (
    select p.*, {best("p")} as best from plain p
)
select j.page_id, j.host, j.path, j.best.rule as rule, coalesce(j.best.verdict, s.component_verdict, 'allow') as verdict, s.component_verdict
from judged j left join said s on j.node = s.node"""


def _normal(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{WS}]+', ' ', 'g'))"


CHAT = f"""
with recursive base as (
    select row_number() over () as rid, conv_id, turn, role, coalesce("text", '') as tx from conversations
), raw_lines as (
    select rid, conv_id, turn, unnest(ls) as raw, unnest(range(1, len(ls) + 1)) as i from (select *, string_split(tx, chr(10)) as ls from base)
), levelled as (
    select *, length(replace(replace(regexp_extract(raw, '^((?:[ \t]*>)*)', 1), ' ', ''), chr(9), '')) as level,
        regexp_replace(raw, '^(?:[ \t]*>)+[ \t]?', '') as line from raw_lines
), filled as (
    select *, regexp_matches(line, '[^{WS}]') as filled from levelled
), begun as (
    select *, filled and (i = 1 or not lag(filled) over w or lag(level) over w <> level) as start from filled window w as (partition by rid order by i)
), runs as (
    select *, sum(start::int) over (partition by rid order by i) as run from begun
), said as (
    select * from (
        select rid, run, any_value(conv_id) as conv_id, any_value(turn) as turn, any_value(level) as level,
            {_normal("string_agg(line, ' ' order by i)")} as passage, list({_normal("line")} order by i) as parts
        from runs where filled group by rid, run
    ) where conv_id is not null and turn is not null
), pieces as (
    select distinct rid, run, conv_id, turn, level, piece from (
        select *, unnest(list_concat(parts, string_split(regexp_replace(passage, '([.!?…]) ', '\\1' || chr(10), 'g'), chr(10)))) as piece from said
    ) where len(string_split(piece, ' ')) >= {chat.PIECE_WORDS}
), firsts as (
    select conv_id, passage, min(turn) as origin from said where level = 0 group by all
), first_pieces as (
    select conv_id, piece, min(turn) as origin from pieces where level = 0 group by all
), whole as (
    select q.rid, q.run, q.conv_id, q.turn, case when f.origin < q.turn then f.origin end as origin
    from said q left join firsts f on q.conv_id = f.conv_id and q.passage = f.passage where q.level > 0
), partly as (
    select p.rid, p.run, max(f.origin) as origin
    from pieces p join first_pieces f on p.conv_id = f.conv_id and p.piece = f.piece and f.origin < p.turn where p.level > 0 group by all
), replies as (
    select w.conv_id, w.turn, count(*) as n_quotes, count(coalesce(w.origin, p.origin)) as n_linked, max(coalesce(w.origin, p.origin)) as parent_turn
    from whole w left join partly p on w.rid = p.rid and w.run = p.run group by w.conv_id, w.turn
), ups(conv_id, turn, up, depth) as (
    select conv_id, turn, parent_turn, 1 from replies where parent_turn is not null
    union all
    select u.conv_id, u.turn, r.parent_turn, u.depth + 1 from ups u join replies r on r.conv_id = u.conv_id and r.turn = u.up where r.parent_turn is not null
), roots as (
    select conv_id, turn, arg_max(up, depth) as up, max(depth) as depth from ups group by conv_id, turn
)
select b.conv_id, b.turn, b.role,
    regexp_replace(array_to_string(list_filter(string_split(tx, chr(10)), lambda x: not regexp_matches(x, '^[ \t]*>')), chr(10)), '^[{WS}]+|[{WS}]+$', '', 'g') as "text",
    coalesce(r.n_quotes, 0)::bigint as n_quotes, coalesce(r.n_linked, 0)::bigint as n_linked, r.parent_turn, coalesce(o.up, b.turn) as root_turn, coalesce(o.depth, 0)::bigint as depth
from base b left join replies r on b.conv_id = r.conv_id and b.turn = r.turn left join roots o on b.conv_id = o.conv_id and b.turn = o.turn"""


WARC = """
with payloads as (
    select page_id, strlen(html)::bigint as n, sha1(html) as x from (select page_id, coalesce(html, '') as html from pages)
), kept as (
    select *, max(page_id) over (partition by x, n) as keeper,
        array_to_string(list_transform(string_split(x, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') as bits
    from payloads
)
select page_id, n as payload_bytes,
    array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        (1 + 16 * bits[5 * i + 1]::int + 8 * bits[5 * i + 2]::int + 4 * bits[5 * i + 3]::int + 2 * bits[5 * i + 4]::int + bits[5 * i + 5]::int)::int]), '') as payload_digest,
    case when page_id < keeper then 'revisit' else 'response' end as record_type,
    case when page_id < keeper then keeper end as refers_to
from kept"""
