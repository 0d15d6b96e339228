"""DuckDB SQL for the registered queries, written apart from the operators over the same star views."""

from __future__ import annotations

from callweave.plans.rendered import CLASSES, EXTENDS
from callweave.plans.star import prelude

TEST = r"(regexp_matches({0}, '(?i)(^|/)(tests?|specs?|__tests__)/') or regexp_matches({0}, '(Test|Tests|IT)\.java$') or regexp_matches({0}, '(?i)_spec\.rb$|_test\.rb$') or regexp_matches({0}, '(?i)\.(test|spec)\.[cm]?[jt]sx?$'))"
FAMILY = "case when {0} in ('typescript', 'tsx', 'javascript') then 'js' else {0} end"
OPEN = f"""open_calls as (
    select r.id as ref_id, r.name, r.receiver, r.arity as call_arity, r.kind as call_kind, r.line, u.reason, f.path as file_path, f.lang, r.from_symbol_id,
        {TEST.format("f.path")} as is_test, {FAMILY.format("f.lang")} as family
    from unresolved u join refs r on r.id = u.ref_id join files f on f.id = r.file_id
    where u.external = 0 and f.external = 0 and r.kind <> 'annotation' and (u.reason is null or u.reason not like 'no-such-%'))"""
REST = r"(s.signature like '%...%' or regexp_matches(s.signature, '[(,]\s*\*'))"
FITS = f"({REST} or case when f.lang = 'java' then c.call_arity = s.arity else c.call_arity <= s.arity end)"
SITES = f"""sites as (
    select s.id, s.name, c.* exclude (name) from symbols s join files f on f.id = s.file_id join open_calls c on c.name = s.name and c.family = {FAMILY.format("f.lang")}
    where (s.kind in ('class', 'interface', 'enum', 'record', 'module')) = (c.call_kind = 'new') and {FITS})"""
GENERATED = "list_contains(string_split(s.modifiers_text, '|'), 'generated')"
TIER = "case when via in ('', 'direct', 'constructor') or via is null then 'proof' when via in ('name-convention', 'unique-name', 'method-missing') then 'guess' when via like 'binding:%' then 'binding' else 'inferred' end"
OUTCOME = "case when u.external = 1 and u.owner in ('js-runtime', 'jdk-runtime', 'Kernel') then 'assumed' when u.external = 1 then 'proof' else 'miss' end"
TYPES = """own_types as (select * from symbols where kind in ('class', 'interface', 'enum', 'record', 'module') and fqn is not null),
types as (select fqn, min(id) as symbol_id, arg_min(kind, id) as kind from own_types group by fqn)"""
GROUPED = """grouped as (select to_symbol_id, from_symbol_id, kind as edge_kind, max(confidence) as confidence, arg_min(via, (-confidence, via)) as via,
    coalesce(array_to_string(list_sort(list(distinct line) filter (line is not null)), '|'), '') as lines from edges group by all)"""
STATS = """counts as (select
    (select count(*) from files where external = 0) as files,
    (select count(*) from symbols s join files f on f.id = s.file_id where f.external = 0) as symbols,
    (select count(*) from types t join symbols s on s.id = t.symbol_id join files f on f.id = s.file_id where f.external = 0) as types,
    (select count(*) from edges) as edges,
    (select count(*) from refs r join files f on f.id = r.file_id where f.external = 0 and r.kind <> 'annotation') as refs,
    (select count(*) from unresolved u join refs r on r.id = u.ref_id join files f on f.id = r.file_id where f.external = 0) as unresolved,
    (select count(*) from unresolved where external = 1) as external)"""
PERCENT = "case when {1} = 0 then 0.0 else round({0} / {1} * 100, 1) end"
FILE_EDGES = """file_edges as (select distinct a.path as src, b.path as dst from edges e join symbols x on x.id = e.from_symbol_id join symbols y on y.id = e.to_symbol_id
    join files a on a.id = x.file_id join files b on b.id = y.file_id where a.path <> b.path and a.external = 0 and b.external = 0)"""
EVIDENCE = """case when owner in ('js-runtime', 'jdk-runtime', 'Kernel') then 'runtime built-in (assumed)'
    when reason in ('external:not-in-project', 'external:receiver-not-declared') then 'name declared nowhere (proven)' when owner is not null then 'named library (proven)' else 'other' end"""
HOT = """hot as (select s.id, s.name, s.fqn, s.kind, f.path as file_path,
        (select count(distinct from_symbol_id) from edges e where e.to_symbol_id = s.id) as callers,
        (select count(distinct c.file_id) from edges e join symbols c on c.id = e.from_symbol_id where e.to_symbol_id = s.id) as caller_files
    from symbols s join files f on f.id = s.file_id
    where f.external = 0 and s.fqn is not null and s.kind in ('method', 'class_method', 'function', 'class', 'interface'))"""
DEAD = f"""unreached as (select s.*, f.path as file_path, f.lang from symbols s join files f on f.id = s.file_id
    where f.external = 0 and s.kind in ('method', 'class_method', 'function') and s.fqn is not null
    and not exists (select 1 from edges e where e.to_symbol_id = s.id) and not exists (select 1 from bindings b where b.symbol_id = s.id)),
listed as (select s.*, (select count(*) from open_calls o where o.name = s.name and o.family = {FAMILY.format("s.lang")}) as unlinked_same_name from unreached s
    where not {TEST.format("s.file_path")} and not regexp_matches(s.modifiers_text, '(^|[|])(abstract|external)($|[|])')
    and not list_has_any(list_transform(string_split(s.annotations_text, '|'), lambda a: string_split(ltrim(a, '@'), '(')[1]), ['Bean', 'Scheduled']))"""
CONFIDENCE = "case when unlinked_same_name = 0 and not (regexp_matches(modifiers_text, '(^|[|])(export|default)($|[|])') or not (regexp_matches(name, '^_|^private') or regexp_matches(modifiers_text, '(^|[|])private($|[|])'))) then 'high' else 'medium' end"
REACH = """reach(seed, id, depth) as (
    select id, id, 0 from symbols where id % 100 = 0 union
    select r.seed, e.from_symbol_id, r.depth + 1 from reach r join edges e on e.to_symbol_id = r.id where r.depth < 4),
nearest as (select seed, id, min(depth) as depth from reach group by seed, id having min(depth) > 0)"""


def _score(q: str, left: str, right: str | None) -> str:
    low = q.lower()
    words = [w for w in low.replace("_", " ").replace("#", " ").split() if w]
    phrase = " " + " ".join(words) + " "
    padded = lambda c: f"(' ' || array_to_string(regexp_extract_all(lower(coalesce({c}, '')), '([\\p{{L}}\\p{{N}}]+)', 1), ' ') || ' ')"
    member = f"when s.name = '{right}' and (s.container_fqn = '{left}' or lower(s.container_fqn) like '%.{left.lower()}') then 100" if right else ""
    hits = " or ".join(f"contains({padded(c)}, '{phrase}')" for c in ("s.name", "s.fqn", "s.signature"))
    return f"case {member} when lower(s.fqn) = '{low}' then 95 when lower(s.name) = '{low}' then 90 when ends_with(lower(s.fqn), '{low}') then 70 when contains(lower(s.name), '{low}') then 50 when {hits} then 30 end - ({GENERATED})::int"


def _search(q: str, left: str, right: str | None = None) -> str:
    return f"select s.id, {_score(q, left, right)} as score, s.fqn, s.name from symbols s join files f on f.id = s.file_id where f.external = 0"


def _singular(w: str) -> str:
    return f"case when regexp_matches({w}, 'ies$') then regexp_replace({w}, 'ies$', 'y') when regexp_matches({w}, '(ch|sh|ss|x|z)es$') then regexp_replace({w}, 'es$', '') when regexp_matches({w}, 's$') and not regexp_matches({w}, '(ss|us|is)$') then regexp_replace({w}, 's$', '') else {w} end"


def _camel(w: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({w}, '_'), lambda x: x <> ''), lambda x: upper(x[1]) || substr(x, 2)), '')"


_MAPPERS = prelude("symbols") + """, named as (select container_fqn, name, row_number() over (partition by container_fqn order by name || '">') as i from (select distinct container_fqn, name from symbols where kind = 'method' and container_fqn is not null and length(name) % 3 <> 2) m)"""
_SCHEMAS = prelude("symbols") + """, named as (select w, name, row_number() over (partition by w order by name) as i from (select distinct regexp_replace(container_fqn, '[^A-Za-z0-9_]', '', 'g') as w, name from symbols where kind = 'method' and container_fqn is not null and length(name) % 3 <> 2) m),
    methods as (select *, regexp_replace(container_fqn, '[^A-Za-z0-9_]', '', 'g') as w from symbols where kind = 'method'), types as (select fqn, arg_min(file_id, id) as file_id, bool_or(id % 8 = 0) as qualified from symbols where kind in ('class', 'interface') and fqn is not null group by fqn),
    served as (select fqn, regexp_replace(fqn, '[^A-Za-z0-9_]', '', 'g') as w from types t where qualified or exists (select 1 from symbols s where s.id % 12 = 4 and s.file_id = t.file_id and s.fqn = t.fqn))"""
_LANDING = prelude("files", "symbols", "edges", "bindings") + """, owned as (select *, 'repo' || file_id % 4 as repo_id from symbols), touched as (select id, count(*) as degree from (select from_symbol_id as id from edges union all select to_symbol_id from edges where to_symbol_id <> from_symbol_id) t group by id),
    ranked as (select o.repo_id, o.id, o.name, coalesce(degree, 0) as degree, case when o.kind in ('class', 'interface', 'module', 'record') then case when degree > 0 then 0 else 2 end when degree > 0 then 1 end as tier from owned o left join touched t using (id)
        where fqn is not null and kind in ('class', 'interface', 'module', 'record', 'method', 'class_method', 'function')),
    hubs as (select repo_id, id from ranked r where tier = (select min(tier) from ranked x where x.repo_id = r.repo_id) qualify row_number() over (partition by repo_id order by degree desc, name, id) <= 10),
    bound as (select distinct o.repo_id, o.id from bindings b join owned o on o.id = b.symbol_id), shown as (select * from bound qualify row_number() over (partition by repo_id order by id) <= 60), seeds as (select repo_id, id from hubs union select repo_id, id from shown),
    pairs as (select distinct co.repo_id as from_repo, c.symbol_id as from_symbol_id, po.repo_id as to_repo, p.symbol_id as to_symbol_id from bindings c join owned co on co.id = c.symbol_id join bindings p on c.plugin = p.plugin and c.key = p.key join owned po on po.id = p.symbol_id where c.role = 'consumer' and p.role = 'provider' and co.repo_id <> po.repo_id),
    ours as (select * from pairs where from_symbol_id in (select id from seeds) or to_symbol_id in (select id from seeds))"""
ORACLE_SQL: dict[str, str] = {
    "j1_located_symbols": prelude("files", "symbols") + " select s.id, s.name, s.fqn, s.kind, s.start_line, f.path as file_path, f.lang, s.modifiers_text as modifiers from symbols s join files f on f.id = s.file_id",
    "j2_callers": prelude("files", "symbols", "edges") + f", {GROUPED} select g.to_symbol_id as of_id, g.from_symbol_id as id, g.edge_kind, g.confidence, g.via, g.lines, s.fqn, f.path as file_path from grouped g join symbols s on s.id = g.from_symbol_id join files f on f.id = s.file_id",
    "j3_callees": prelude("files", "symbols", "edges") + f", {GROUPED} select g.from_symbol_id as of_id, g.to_symbol_id as id, g.edge_kind, g.confidence, g.via, g.lines, s.fqn, s.start_line from grouped g join symbols s on s.id = g.to_symbol_id join files f on f.id = s.file_id",
    "j4_neighbours": prelude("edges", "symbols") + " select s.id, case when e.from_symbol_id = s.id then e.to_symbol_id else e.from_symbol_id end as other, e.kind, max(e.confidence) as confidence, count(*) as n from symbols s join edges e on e.from_symbol_id = s.id or e.to_symbol_id = s.id group by all",
    "j5_file_edges": prelude("files", "symbols", "edges") + f", {FILE_EDGES} select * from file_edges",
    "j6_unlinked_calls": prelude("files", "symbols", "refs", "unresolved") + f", {OPEN} select o.ref_id, o.name, o.receiver, o.call_arity, o.call_kind, o.line, o.reason, o.file_path, o.lang, o.from_symbol_id, s.fqn as from_fqn, o.is_test from open_calls o left join symbols s on s.id = o.from_symbol_id",
    "j7_route_endpoints": prelude("files", "symbols", "bindings") + " select b.id, b.key, b.role, b.detail, b.line, f.path as file_path, s.fqn from bindings b join files f on f.id = b.file_id left join symbols s on s.id = b.symbol_id where b.plugin = 'http'",
    "j8_unreached": prelude("files", "symbols", "edges", "bindings") + """ select s.id, s.name, f.path as file_path from symbols s join files f on f.id = s.file_id where f.external = 0 and s.kind in ('method', 'class_method', 'function') and s.fqn is not null
        and not exists (select 1 from edges e where e.to_symbol_id = s.id) and not exists (select 1 from bindings b where b.symbol_id = s.id)""",
    "j9_declared_names": prelude("files", "symbols", "refs") + " select id, name, kind from refs where name in (select s.name from symbols s join files f on f.id = s.file_id where f.external = 0)",
    "j10_endpoint_pairs": prelude("bindings") + " select distinct c.symbol_id as from_symbol_id, p.symbol_id as to_symbol_id, 'binds' as kind, 0.9::double as confidence, 'binding:' || c.plugin as via, c.line from bindings c join bindings p on c.plugin = p.plugin and c.key = p.key where c.role = 'consumer' and p.role = 'provider' and c.symbol_id <> p.symbol_id",
    "j11_cross_repo_pairs": prelude("bindings") + " select distinct c.repo_id as from_repo, c.symbol_id as from_symbol_id, p.repo_id as to_repo, p.symbol_id as to_symbol_id, c.plugin, c.key, 0.85::double as confidence from bindings c join bindings p on c.plugin = p.plugin and c.key = p.key where c.role = 'consumer' and p.role = 'provider' and c.repo_id <> p.repo_id and c.symbol_id is not null and p.symbol_id is not null",
    "j12_longest_prefix": prelude("files") + ", prefixes as (select distinct split_part(path, '/', 1) as prefix from files union select distinct regexp_replace(path, '/[^/]*$', '') from files where lines % 2 = 0) select f.path, arg_max(p.prefix, length(p.prefix)) as prefix from (select distinct path from files) f left join prefixes p on f.path = p.prefix or starts_with(f.path, p.prefix || '/') group by f.path",
    "j13_innermost_symbol": prelude("symbols", "refs") + """, inside as (select r.id, arg_min(s.id, (s.end_line - s.start_line, s.id)) as symbol_id from refs r join symbols s on s.file_id = r.file_id and r.line between s.start_line and s.end_line group by r.id),
        anchors as (select file_id, arg_min(id, (start_line, id)) as symbol_id from symbols where kind in ('class', 'module', 'function') group by file_id)
        select r.id, r.file_id, r.line, coalesce(i.symbol_id, a.symbol_id) as symbol_id, i.symbol_id is not null as contained from refs r left join inside i on i.id = r.id left join anchors a on a.file_id = r.file_id""",
    "j14_first_new_on_line": prelude("refs") + " select c.id, c.from_symbol_id, c.line, n.event from refs c join (select from_symbol_id, line, arg_min(name, id) as event from refs where kind = 'new' group by all) n on n.from_symbol_id = c.from_symbol_id and n.line = c.line where c.kind = 'call'",
    "j15_last_annotation": prelude("refs") + " select from_symbol_id, name, max(id) as ref_id from refs where kind = 'annotation' and from_symbol_id is not null group by all",
    "j16_tables_to_classes": prelude("symbols") + f""", t as (select distinct lower(regexp_replace(o_orderpriority, '[^A-Za-z]+', '_', 'g')) as t from orders union select distinct name || 's' from symbols),
        s1 as (select t, {_singular("t")} as s from t), offered as (select t, {_camel("s")} as name from s1 union select t, {_camel(_singular("s"))} from s1 union select t, t from s1 union select t, s from s1)
        select distinct o.t, o.name, s.id from offered o join symbols s on s.name = o.name""",
    "j17_first_model": prelude("symbols") + f""", t as (select distinct name || 'es' as t from symbols), forms as (select t, list_distinct([{_singular("t")}]) as f1, regexp_replace(t, 'es$', '') as f2, regexp_replace(t, 's$', '') as f3 from t),
        offered as (select t, 0 as pos, {_camel("f1[1]")} as model from forms union all select t, 1, {_camel("f2")} from forms union all select t, 2, {_camel("f3")} from forms union all select t, 3, {_camel("t")} from forms)
        select o.t, arg_min(o.model, o.pos) as model from offered o where o.model in (select {_camel("name")} from symbols) group by o.t""",
    "j18_supertype_links": prelude("symbols") + f", {TYPES} select distinct s.from_symbol_id, t.symbol_id as to_symbol_id, s.fqn from (select id as from_symbol_id, unnest(string_split(supertypes_text, '|')) as fqn from symbols) s join types t on t.fqn = s.fqn",
    "j19_correlated_counts": prelude("symbols", "edges") + " select s.id, (select count(*) from edges e where e.to_symbol_id = s.id or e.from_symbol_id = s.id) as degree, (select count(*) from symbols o where o.name = s.name) as declared from symbols s",
    "j20_chain_depth": prelude("refs").replace("with ", "with recursive ", 1) + ", walk(id, place, depth) as (select id, receiver_ref_id, 0 from refs union all select w.id, r.receiver_ref_id, w.depth + 1 from walk w left join refs r on r.id = w.place where w.place is not null and w.depth < 4) select id, max(depth)::int as depth from walk group by id",
    "j21_members": prelude("symbols") + " select t.id as type_id, m.id as member_id from symbols m join symbols t on m.container_fqn = t.fqn where t.kind in ('class', 'interface', 'enum', 'record', 'module') and m.kind in ('method', 'constructor', 'class_method', 'field')",
    "j22_subtypes": prelude("symbols", "edges") + " select distinct e.to_symbol_id as type_id, e.from_symbol_id as subtype_id, s.fqn as subtype, e.kind from edges e join symbols s on s.id = e.from_symbol_id where e.kind in ('implements', 'extends')",
    "p2_public_shape": prelude("files", "symbols") + f" select s.id, coalesce(s.fqn, s.name) as fqn, f.path as file, case when {GENERATED} then 'true' else 'false' end as derived, case when {TEST.format('f.path')} then 'true' else 'false' end as is_test from symbols s join files f on f.id = s.file_id",
    "f5_test_paths": prelude("files") + f" select path, {TEST.format('path')} as is_test, lang from files",
    "f6_arity_fits": prelude("files", "symbols", "refs") + f" select s.id, count(*) filter ({FITS}) as fitting, count(*) as calls from symbols s join files f on f.id = s.file_id join (select name, arity as call_arity from refs where kind <> 'annotation') c on c.name = s.name group by s.id",
    "f9_framework_and_public": prelude("symbols") + f" select s.id, list_has_any(list_transform(string_split(s.annotations_text, '|'), lambda a: string_split(ltrim(a, '@'), '(')[1]), ['Bean', 'Scheduled']) or regexp_matches(s.modifiers_text, '(^|[|])(abstract|external)($|[|])') as framework, regexp_matches(s.modifiers_text, '(^|[|])(export|default)($|[|])') or not regexp_matches(s.modifiers_text, '(^|[|])private($|[|])') as public, {GENERATED} as generated from symbols s",
    "f12_routes_without_shadows": prelude("bindings") + " select id, key, role from bindings b where plugin = 'http' and not (role = 'provider' and key like 'ANY %' and exists (select 1 from bindings o where o.plugin = 'http' and o.key not like 'ANY %' and split_part(o.key, ' ', 2) = split_part(b.key, ' ', 2)))",
    "f13_edge_groups": prelude("edges") + " select case when via like 'binding:%' then 'wired' when kind in ('calls', 'instantiates') then 'calls' when kind in ('extends', 'implements', 'includes') then 'inherits' else 'other' end as relation, count(*) as n from edges group by all",
    "a1_project_stats": prelude("files", "symbols", "edges", "refs", "unresolved") + f", {TYPES}, {STATS} select * from counts",
    "a1_files_by_language": prelude("files") + " select lang, count(*) as n from files where external = 0 group by lang",
    "a2_resolution": prelude("files", "symbols", "edges", "refs", "unresolved") + f", {TYPES}, {STATS} select refs, refs - unresolved as linked, external as library, unresolved - external as missed, {PERCENT.format('(refs - unresolved)', '(refs - external)')} as resolution_pct, {PERCENT.format('external', 'refs')} as library_pct from counts",
    "a3_evidence": prelude("unresolved") + f" select {EVIDENCE} as evidence, count(*) as n from unresolved where external = 1 group by all",
    "a4_guessed_links": prelude("edges") + " select via, count(*) as n from edges where via in ('name-convention', 'unique-name', 'method-missing') group by via",
    "a5_floor": prelude("files", "symbols", "edges", "refs", "unresolved") + f""", {TYPES}, {STATS}, lows as (select (select count(*) from unresolved where external = 1 and owner in ('js-runtime', 'jdk-runtime', 'Kernel')) as assumed, (select count(*) from edges where via in ('name-convention', 'unique-name', 'method-missing')) as guessed)
        select assumed, guessed, {PERCENT.format("(refs - unresolved - guessed)", "(refs - external + assumed)")} as floor_pct from counts, lows""",
    "a6_endpoint_counts": prelude("bindings") + " select plugin, count(*) filter (role = 'provider') as provider, count(*) filter (role = 'consumer') as consumer from bindings group by plugin",
    "a7_dependencies": prelude("files") + " select count(distinct owner) as libraries, count(*) as files, count(*) filter (path like 'jvm:%') as jvm_types from files where external = 1",
    "a8_top_libraries": prelude("unresolved") + " select owner, count(*) as n from unresolved where external = 1 and owner is not null group by owner order by n desc, owner limit 10",
    "a8_miss_reasons": prelude("unresolved") + " select reason, count(*) as n from unresolved where external = 0 group by reason order by n desc, reason nulls first limit 6",
    "a8_missed_names": prelude("unresolved", "refs") + " select r.receiver, r.name, count(*) as n from unresolved u join refs r on r.id = u.ref_id where u.external = 0 group by all order by n desc, r.receiver nulls first, r.name limit 10",
    "a9_hotspots": prelude("files", "symbols", "edges") + f", {HOT} select * from hot where callers > 0",
    "a10_degree": prelude("edges") + " select id, count(*) as degree from (select from_symbol_id as id from edges union all select to_symbol_id from edges where to_symbol_id <> from_symbol_id) group by id",
    "a11_grouped_edges": prelude("edges") + f", {GROUPED} select to_symbol_id as of_id, from_symbol_id as id, edge_kind, confidence, via, lines from grouped",
    "a12_types_view": prelude("symbols") + f""", {TYPES}, said as (select fqn, id, unnest(list_filter(string_split(supertypes_text, '|'), lambda x: x <> '')) as sup, unnest(range(len(list_filter(string_split(supertypes_text, '|'), lambda x: x <> '')))) as pos from own_types),
        firsts as (select fqn, sup, min((id, pos)) as at from said group by all) select t.fqn, t.symbol_id, t.kind, coalesce(string_agg(f.sup, '|' order by f.at), '') as supertypes from types t left join firsts f on f.fqn = t.fqn group by all""",
    "a13_candidate_callers": prelude("files", "symbols", "refs", "unresolved") + f", {OPEN}, {SITES} select id, file_path, is_test, count(*) as sites, array_to_string(list_sort(list(line)), '|') as lines, array_to_string(list_sort(list(distinct coalesce(reason, 'unresolved'))), '|') as reasons from sites group by id, file_path, is_test",
    "a14_candidate_tests": prelude("files", "symbols", "refs", "unresolved") + f""", {OPEN}, {SITES}, often as (select s.name from symbols s join files f on f.id = s.file_id where f.external = 0 group by s.name having count(*) > 3)
        select c.file_path, array_to_string(list_sort(list(distinct s.name)), '|') as names, array_to_string(list_sort(list(distinct c.line)), '|') as lines from sites c join symbols s on s.id = c.id join files f on f.id = s.file_id
        where c.is_test and not {TEST.format("f.path")} and not {GENERATED} and s.name not in (select name from often) group by c.file_path""",
    "a15_explained": prelude("edges", "refs", "unresolved") + f""", pairs as (select from_symbol_id, to_symbol_id, arg_min(via, (-confidence, via)) as via from edges group by from_symbol_id, to_symbol_id, kind), tiers as (select *, {TIER} as tier from pairs)
        select id, side, tier, count(*) as n from (select to_symbol_id as id, 'callers' as side, tier from tiers union all select from_symbol_id, 'callees', tier from tiers
        union all select r.from_symbol_id, 'calls', {OUTCOME} from unresolved u join refs r on r.id = u.ref_id where r.from_symbol_id is not null) group by all""",
    "a16_overview": "with repos as (select s_nationkey, count(*) as symbols, sum(s_suppkey % 7) as edges, round(sum(s_suppkey % 11) * 10 / count(*), 1) as resolution from supplier group by s_nationkey) select count(*) as repos, sum(symbols)::bigint as symbols, sum(edges)::bigint as edges, round(sum(resolution * symbols) / greatest(sum(symbols), 1), 1) as resolution from repos",
    "a18_wired": prelude("edges") + " select split_part(via, ':', 2) as plugin, count(*) as wired from edges where via like 'binding:%' group by all",
    "a19_import_fingerprint": prelude("imports") + " select file_id, sha1(string_agg(fqn, chr(10) order by fqn)) as fingerprint from (select distinct file_id, fqn from imports) group by file_id",
    "a20_unique_names": prelude("symbols") + " select fqn as name, min(id) as id from symbols where fqn is not null group by fqn having count(*) = 1",
    "o1_search": prelude("files", "symbols") + f" select id, score, fqn from ({_search('red_w', 'red_w')}) where score is not null order by score desc, coalesce(fqn, name), id limit 20",
    "o3_top_hotspots": prelude("files", "symbols", "edges") + f", {HOT} select * from hot where callers > 0 order by callers desc, caller_files desc, name, id limit 20",
    "o4_hubs": prelude("files", "symbols", "edges") + " select s.id, s.name, s.fqn, s.kind, f.path as file_path, (select count(*) from edges e where e.to_symbol_id = s.id or e.from_symbol_id = s.id) as degree from symbols s join files f on f.id = s.file_id where s.kind in ('class', 'interface', 'module', 'record') and s.fqn is not null order by degree desc, s.name, s.id limit 12",
    "o7_ties": prelude("files", "symbols") + f", top as (select id, score, fqn from ({_search('red_widget', 'red_widget')}) where score is not null order by score desc, coalesce(fqn, name), id limit 10) select * from top where score = (select max(score) from top)",
    "b1_mapper_statements": _MAPPERS + """ select 'sql:' || container_fqn || '#' || name as fqn, '<select id="' || name || '">' as signature, (1 + 3 * i)::int as start_line, (3 + 3 * i)::int as end_line, container_fqn from named
        union all select 'sql:' || container_fqn || '#stray', '<update id="stray">', (4 + 3 * max(i))::int, (4 + 3 * max(i))::int, container_fqn from named group by container_fqn""",
    "b1_mapper_edges": _MAPPERS + " select s.id as from_symbol_id, 'sql:' || n.container_fqn || '#' || n.name as to_fqn, 'implemented-by' as kind, 0.95::double as confidence, 'binding:mybatis' as via, s.start_line as line from symbols s join named n on n.container_fqn = s.container_fqn and n.name = s.name where s.kind = 'method'",
    "b8_schema_fields": _SCHEMAS + """ select 'graphql:' || w || '.id' as fqn, 'id' as name, w as container_fqn, 'id: ID!' as signature, 5 as start_line, 5 as end_line from named group by w
        union all select 'graphql:Query.' || name, name, 'Query', name || '(first: Int = 5, after: String): [' || w || '!]! @auth(role: "x: y")', (6 + 2 * i)::int, (7 + 2 * i)::int from named""",
    "b8_schema_edges": _SCHEMAS + """, fields as (select 'Query.' || name as key, (6 + 2 * i)::int as line from named union all select w || '.id', 5 from named group by w),
        answers as (select id, case id % 3 when 0 then 'Query.' || name when 1 then w || '.id' else 'Query.' || name || case when id % 2 = 0 or id % 7 = 0 then '_all' else '' end end as key from methods)
        select 'graphql:' || key as from_fqn, a.id as to_symbol_id, 'implemented-by' as kind, 0.9::double as confidence, 'binding:graphql' as via, line from fields join answers a using (key)""",
    "b9_rpc_methods": _SCHEMAS + " select 'rpc:' || w || '/' || upper(name[1]) || name[2:] as fqn, upper(name[1]) || name[2:] as name, w as container_fqn, 'rpc ' || upper(name[1]) || name[2:] as signature, (3 * i)::int as start_line, (3 * i)::int as end_line from named",
    "b9_rpc_edges": _SCHEMAS + " select 'rpc:' || n.w || '/' || upper(n.name[1]) || n.name[2:] as from_fqn, m.id as to_symbol_id, 'implemented-by' as kind, 0.9::double as confidence, 'binding:grpc' as via, (3 * i)::int as line from named n join served s on s.w = n.w join methods m on m.container_fqn = s.fqn and m.name = n.name",
    "r15_ruby_fallbacks": """with c as (select *, k * 7 % m + 1 as j from (select p_partkey::bigint as k, max(p_partkey::bigint) over () as m from part) p), calls as (
        select k, 'C' || k || '#name' || k as to_fqn, 'self-chain' as via, 0.7::double as confidence, 8 as line from c union all select k, 'Object#top' || k % 3, 'self-chain', 0.7, 11 from c
        union all select k, 'C' || k || '#c' || k + 1, 'self-chain', 0.7, 9 from c where k < m union all select k, 'C' || k + 1 || '#name' || k + 1, 'rails-association', 0.8, 9 from c where k < m
        union all select k, 'C' || j || '#name' || j, case when j % 3 = 0 then 'name-convention' else 'unique-name' end, case when j % 3 = 0 then 0.5 else 0.4 end, 10 from c where j <> k + 1
        union all select k, 'C' || j || '#method_missing', 'method-missing', 0.4, 13 from c where j % 3 <> 0 and j % 4 = 0)
        select 'C' || k || '#go' || k as from_fqn, to_fqn, via, confidence::double as confidence, line from calls""",
    "o9_merged_search": prelude("files", "symbols") + f", hits as (select 'repo' || s.file_id % 4 as repo_id, h.id, h.score, coalesce(h.fqn, s.name) as fqn from ({_search('red', 'red')}) h join symbols s on s.id = h.id where score is not null) select * from (select * from hits qualify row_number() over (partition by repo_id order by score desc, fqn, id) <= 25) order by score desc, fqn, repo_id, id limit 25",
    "g15_landing_nodes": _LANDING + " select node, any_value(repo_id) as repo_id, ['repo', 'hub', 'endpoint', 'linked'][min(rank) + 1] as kind from (select 'repo:' || repo_id as node, repo_id, 0 as rank from owned group by all union all select repo_id || ':' || id, repo_id, 1 from hubs union all select repo_id || ':' || id, repo_id, 2 from shown union all select from_repo || ':' || from_symbol_id, from_repo, 3 from ours union all select to_repo || ':' || to_symbol_id, to_repo, 3 from ours) n group by node",
    "g15_landing_links": _LANDING + """ select kind, count(*) as n, count(distinct a) as sources, count(distinct b) as targets from (select 'contains' as kind, repo_id as a, repo_id || ':' || id as b from seeds
        union all select distinct e.kind, x.repo_id || ':' || e.from_symbol_id, x.repo_id || ':' || e.to_symbol_id from edges e join hubs x on x.id = e.from_symbol_id join hubs y on y.id = e.to_symbol_id and y.repo_id = x.repo_id where e.from_symbol_id <> e.to_symbol_id
        union all select 'binds', from_repo || ':' || from_symbol_id, to_repo || ':' || to_symbol_id from ours) l group by kind""",
    "g15_landing_left_out": _LANDING + " select repo_id, count(*) as endpoints, greatest(count(*) - 60, 0) as left_out from bound group by repo_id",
    "g19_symbol_details": prelude("files", "symbols", "edges").replace("with ", "with recursive ", 1) + f""", {REACH}, grouped as (select to_symbol_id as id, from_symbol_id as other, kind, arg_min(via, (-confidence, via)) as via, 'in' as way from edges group by to_symbol_id, from_symbol_id, kind union all select from_symbol_id, to_symbol_id, kind, arg_min(via, (-confidence, via)), 'out' from edges group by from_symbol_id, to_symbol_id, kind),
        blast as (select n.seed as id, count(*) as symbols, count(distinct f.path) as files from nearest n join symbols s on s.id = n.id join files f on f.id = s.file_id group by n.seed)
        select s.id, case when s.kind in ('class', 'interface', 'enum', 'record', 'module') then (select count(*) from symbols m where m.container_fqn = s.fqn and m.kind in ('method', 'constructor', 'class_method', 'field')) else 0 end as members,
            (select count(*) from grouped g where g.id = s.id and way = 'in' and g.kind in ('calls', 'instantiates')) as callers, (select count(*) from grouped g where g.id = s.id and way = 'out' and g.kind in ('calls', 'instantiates')) as callees,
            (select count(*) from grouped g where g.id = s.id and way = 'in' and starts_with(via, 'binding:')) as wired_in, (select count(*) from grouped g where g.id = s.id and way = 'out' and starts_with(via, 'binding:')) as wired_out,
            (select count(*) from grouped g where g.id = s.id and g.kind in ('extends', 'implements', 'includes')) as related, coalesce(b.symbols, 0) as blast_symbols, coalesce(b.files, 0) as blast_files
        from symbols s left join blast b on b.id = s.id where s.id % 100 = 0""",
    "o10_clamped": "select event_id, case when event_id % 5 = 0 then 20 else least(greatest(event_id - 300, 1), 200) end::bigint as limited from events",
    "s13_search_tiers": prelude("files", "symbols") + f", found as (select 'T1#red_widget' as query, id, score from ({_search('T1#red_widget', 'T1', 'red_widget')}) union all select 'Blue_Bolt', id, score from ({_search('Blue_Bolt', 'Blue_Bolt')}) union all select 'red widget', id, score from ({_search('red widget', 'red widget')})) select * from found where score is not null",
    "u3_unread_imports": prelude("imports", "symbols") + " select fqn from imports except select fqn from symbols where fqn is not null",
    "u4_missing_paths": prelude("files") + " select concat('lib/n', s_nationkey, '/', replace(s_name, '#', ''), '.rb') as path from supplier except select path from files",
    "u8_kept_edges": prelude("files", "symbols", "edges") + ", own as (select s.id from symbols s join files f on f.id = s.file_id where f.external = 0) select from_symbol_id, to_symbol_id, kind, line from edges where from_symbol_id in (select id from own) and to_symbol_id in (select id from own)",
    "g2_impact": prelude("files", "symbols", "edges").replace("with ", "with recursive ", 1) + f", {REACH.replace('symbols where id % 100 = 0', 'symbols')} select n.seed, count(*) as total_symbols, count(distinct f.path) as total_files, {', '.join(f'count(*) filter (depth = {d}) as level_{d}' for d in range(1, 5))} from nearest n join symbols s on s.id = n.id join files f on f.id = s.file_id group by n.seed",
    "g3_affected": prelude("files", "symbols", "edges").replace("with ", "with recursive ", 1) + f""", changed as (select s.id from symbols s join files f on f.id = s.file_id where f.lang = 'ruby'), reach(id, depth) as (
        select id, 0 from changed union select e.from_symbol_id, r.depth + 1 from reach r join edges e on e.to_symbol_id = r.id where r.depth < 4)
        select r.id, f.path, min(r.depth)::int as depth, {TEST.format("f.path")} as is_test from reach r join symbols s on s.id = r.id join files f on f.id = s.file_id where r.id not in (select id from changed) group by r.id, f.path""",
    "g6_shortest_paths": prelude("symbols", "edges").replace("with ", "with recursive ", 1) + """, hops as (select distinct from_symbol_id as a, to_symbol_id as b from edges union select t.id, m.id from symbols m join symbols t on m.container_fqn = t.fqn where t.kind in ('class', 'interface', 'enum', 'record', 'module') and m.kind in ('method', 'constructor', 'class_method', 'field')),
        reach(id, depth) as (select 0::bigint, 0 union select h.b, r.depth + 1 from reach r join hops h on h.a = r.id where r.depth < 12) select id, min(depth)::int as depth from reach group by id""",
    "g8_file_rings": prelude("files", "symbols", "edges") + f", {FILE_EDGES} select a.src || ' -> ' || a.dst as ring, 2 as length from file_edges a join file_edges b on a.dst = b.src and b.dst = a.src where a.src < a.dst union all select a.src || ' -> ' || a.dst || ' -> ' || b.dst, 3 from file_edges a join file_edges b on a.dst = b.src join file_edges c on b.dst = c.src and c.dst = a.src where a.src < a.dst and a.src < b.dst and a.dst <> b.dst",
    "g8_module_rings": """with recursive n as (select count(*) as n from customer), links as (select distinct src, dst from (select c_custkey as src, (c_custkey + 1 + c_nationkey % 5) % n as dst from customer, n union all select c_custkey, (c_custkey * 7 + c_nationkey) % n from customer, n) where src <> dst),
        walk(a, z, ring) as (select src, dst, [src, dst] from links where src < dst union all select w.a, l.dst, list_append(w.ring, l.dst) from walk w join links l on l.src = w.z where l.dst > w.a and not list_contains(w.ring, l.dst) and len(w.ring) < 7)
        select array_to_string(w.ring, ' -> ') as ring, len(w.ring)::int as length from walk w join links l on l.src = w.z and l.dst = w.a""",
    "g8_strong_components": """with recursive links as (select distinct src, dst from (select o_custkey as src, o_custkey // 32 * 32 + (o_orderkey * 5 + o_custkey * 3) % 32 as dst from orders where o_orderkey % 7 = 0) where src <> dst),
        reach(a, b) as (select src, dst from links union select r.a, l.dst from reach r join links l on l.src = r.b),
        mutual as (select x.a as id, x.b as other from reach x join reach y on x.a = y.b and x.b = y.a), named as (select id, min(other) as component from mutual group by id)
        select id, component, count(*) over (partition by component) as size from named""",
    "g9_dead_code": prelude("files", "symbols", "edges", "bindings", "refs", "unresolved") + f", {OPEN}, {DEAD}, words as (select distinct unnest(regexp_extract_all(\"text\", '([A-Za-z_$][\\w$]*)', 1)) as w from documents) select id, name, fqn, kind, file_path, start_line, unlinked_same_name, {CONFIDENCE} as confidence from listed where name not in (select w from words)",
    "g9_held_back": prelude("files", "symbols", "edges", "bindings", "refs", "unresolved") + f", {OPEN}, {DEAD}, rated as (select *, {CONFIDENCE} as confidence from listed) select count(*) filter (confidence = 'high') as certain, count(*) filter (confidence = 'medium' and unlinked_same_name = 0) as public_held_back, count(*) filter (confidence = 'medium' and unlinked_same_name > 0) as name_held_back from rated",
    "g17_diagnosis": prelude("files", "symbols", "imports") + ", wanted as (select distinct f.lang, i.fqn from imports i join files f on f.id = i.file_id), c as (select lang, count(*) as imported, count(*) filter (fqn not in (select fqn from symbols where fqn is not null)) as unread from wanted group by lang) select lang, imported, unread, case when unread * 100 > 20 * imported then 'blocking' when unread > 0 then 'minor' else 'good' end as verdict from c",
    "g18_routes": prelude("bindings") + ", kept as (select * from bindings b where plugin = 'http' and not (role = 'provider' and key like 'ANY %' and exists (select 1 from bindings o where o.plugin = 'http' and o.key not like 'ANY %' and split_part(o.key, ' ', 2) = split_part(b.key, ' ', 2)))) select key, count(*) filter (role = 'provider') as providers, count(*) filter (role <> 'provider') as consumers from kept group by key",
    "s3_inflection": prelude("symbols") + f", w as (select distinct unnest([name, name || 's', name || 'ies', name || 'ches', name || 'us']) as w from symbols), s as (select w, {_singular('w')} as singular from w) select w, singular, {_camel('w')} as camel, {_camel('singular')} as class_name from s",
    "s7_module_paths": prelude("files") + " select path, regexp_replace(path, '\\.(tsx?|jsx?|mts|cts|mjs|cjs)$', '') as module, case when lines % 2 = 0 then '@' || split_part(path, '/', 1) || '/' || split_part(path, '/', 2) else split_part(path, '/', 1) end as package from files",
    "s8_normal_paths": "with p as (select page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^[^/]*//[^/]*', '') as p from pages), q as (select page_id, regexp_replace(regexp_replace(case when p = '' then '/' else p end, '/\\d+(/|$)', '/{}\\1', 'g'), ':[A-Za-z_]\\w*', '{}', 'g') as p from p) select page_id, case when length(p) > 1 then regexp_replace(p, '/$', '') else p end as route from q",
    "s12_phrases": "select doc_id from documents where contains(' ' || array_to_string(regexp_extract_all(lower(\"text\"), '([\\p{L}\\p{N}]+)', 1), ' ') || ' ', ' the and ')",
    "s14_lines": "select doc_id, (length(\"text\") - length(replace(\"text\", chr(10), '')) + 1)::int as n_lines, (length(substr(\"text\", 1, length(\"text\") // 2)) - length(replace(substr(\"text\", 1, length(\"text\") // 2), chr(10), '')) + 1)::int as middle from documents",
    "src5_admission": "select doc_id, case when length(\"text\") > 2097152 then 'too-large' when instr(substr(\"text\", 1, 8000), chr(0)) > 0 then 'binary' when length(\"text\") > 20480 and length(\"text\") / (length(\"text\") - length(replace(\"text\", chr(10), '')) + 1) > 1000 then 'packed' else 'ok' end as admission, sha1(\"text\") as hash from documents",
    "src8_template_words": "select distinct unnest(regexp_extract_all(html, '([A-Za-z_$][\\w$]*)', 1)) as word from pages",
    "st1_sync_status": """with stored as (select c_name as path, sha1(c_mktsegment) as h from customer), listed as (select case when c_custkey % 9 = 0 then c_name || '.new' else c_name end as path, sha1(case when c_custkey % 7 = 0 then 'x' else c_mktsegment end) as h from customer where c_custkey % 10 <> 0)
        select case when s.path is null then 'added' when l.path is null then 'removed' when s.h = l.h then 'unchanged' else 'changed' end as status, count(*) as n from stored s full join listed l on s.path = l.path group by all""",
}

_CLASSES = "with recursive classes as (" + CLASSES.format(part="part") + ")"
_GO = "go as (select *, fqn || '.go' || k as caller, 1 + (k < m)::int as up, 2 + (k < m)::int + 3 * (k = root)::int as top, 'pkg.n' || root % 5 || '.C' || root as above from classes)"
_DIAMONDS = "with recursive links as (" + EXTENDS.replace(" div ", " // ").format(customer="customer") + """), up as (select k, j, row_number() over (partition by k order by turn, j) - 1 as at from links),
    walk(k, j, path) as (select c_custkey, c_custkey, []::bigint[] from customer union all select w.k, u.j, list_append(w.path, u.at) from walk w join up u on u.k = w.j),
    least_path as (select 'dia.D' || k as fqn, 'dia.D' || j as ancestor, min(path) as path from walk group by all)"""
ORACLE_SQL |= {
    "ext_java_symbols": f"""{_CLASSES}, {_GO} select path, 'pkg.n' || k % 5 as pkg, fqn, kind, container_fqn, arity, start_line, params, supertypes from (
        select path, k, fqn, 'class' as kind, null as container_fqn, null::int as arity, up + 1 as start_line, '' as params, case when k % 4 <> 0 and k < m then 'C' || (k + 1) else '' end as supertypes from go
        union all select path, k, caller, 'method', fqn, 1, top + 1, 'int', '' from go
        union all select path, k, fqn || '.size', 'method', fqn, 0, up + 2, '', '' from go where k = root
        union all select path, k, fqn || '.put', 'method', fqn, 1, up + 3, 'int', '' from go where k = root
        union all select path, k, fqn || '.put', 'method', fqn, 1, up + 4, 'String', '' from go where k = root) s""",
    "ext_java_calls": f"""{_CLASSES}, {_GO} select caller as fqn, name, receiver, arity, (top + 1 + below)::int as line, kind, strings from (
        select caller, top, unnest([
            {{'name': 'size', 'receiver': null, 'arity': 0, 'below': 1, 'kind': 'call', 'strings': ''}}, {{'name': 'put', 'receiver': null, 'arity': 1, 'below': 3, 'kind': 'call', 'strings': 'x'}},
            {{'name': 'put', 'receiver': null, 'arity': 1, 'below': 4, 'kind': 'call', 'strings': ''}}, {{'name': 'put', 'receiver': null, 'arity': 1, 'below': 5, 'kind': 'call', 'strings': ''}},
            {{'name': 'missing' || k % 3, 'receiver': null, 'arity': 0, 'below': 6, 'kind': 'call', 'strings': ''}}, {{'name': 'trim', 'receiver': 't', 'arity': 0, 'below': 7, 'kind': 'call', 'strings': ''}},
            {{'name': 'C' || (k + 1), 'receiver': null, 'arity': 0, 'below': 8, 'kind': 'new', 'strings': ''}}], recursive := true) from go) c
        where kind = 'call' or exists (select 1 from go g where g.caller = c.caller and g.k < g.m)""",
    "r4_java_edges": f"""{_CLASSES}, {_GO} select caller as from_fqn, above || '.size' as to_fqn, '' as to_params, 'calls' as kind, 'direct' as via, 1.0 as confidence, (top + 2)::int as line from go
        union all select caller, above || '.put', 'String', 'calls', 'direct', 1.0, (top + 4)::int from go
        union all select caller, above || '.put', 'int', 'calls', 'direct', 1.0, (top + 5)::int from go
        union all select caller, above || '.put', 'String', 'calls', 'direct', 1.0, (top + 6)::int from go
        union all select caller, 'pkg.n' || (k + 1) % 5 || '.C' || (k + 1), '', 'instantiates', 'direct', 1.0, (top + 9)::int from go where k < m
        union all select fqn, 'pkg.n' || (k + 1) % 5 || '.C' || (k + 1), '', 'extends', 'declaration', 1.0, (up + 1)::int from go where k % 4 <> 0 and k < m""",
    "r2_ancestor_order": f"""{_DIAMONDS} select fqn, ancestor, row_number() over (partition by fqn order by path) - 1 as place from least_path""",
    "r4_diamond_calls": f"""{_DIAMONDS} select fqn || '.go' || k as from_fqn, arg_min(ancestor, path) || '.m' || m as to_fqn, 'direct' as via, (6 + m)::int as line from (select l.*, regexp_extract(l.ancestor, '[0-9]+')::bigint % 4 as m, regexp_extract(l.fqn, '[0-9]+')::bigint as k from least_path l) group by fqn, k, m""",
    "r17_java_unresolved": f"""{_CLASSES}, {_GO} select caller as fqn, 'missing' || k % 3 as name, (top + 7)::int as line, 'external:not-in-project' as reason, 1 as external, null as owner from go
        union all select caller, 'trim', (top + 8)::int, 'external:java.lang', 1, 'java.lang' from go""",
}
