"""Joins, spans and trees over relations made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.folding import fold_sql
from ..functions.kinds import PSEUDO_ASSEMBLIES
from ..operators import closure, extract, graph, hierarchy, numbering, ranges, references as refs_, search, selection, spans, stats
from ..registered import query
from ..runtime import dealt
from ..sources import testdata as td


def _key(c):
    from ..functions import ids

    return ids.symbol_id(F.concat(F.lit("T:"), c.cast("string")))


@query(
    "interface_members",
    f"with {td.SYMBOLS_SQL}, e as (select substr(md5('T:' || p_partkey), 1, 16) as member_id, substr(md5('T:' || (p_partkey // k)), 1, 16) as base_id from part, (values (2), (3), (1000)) v(k)) select e.member_id, e.base_id, m.name as member, b.name as base, b.assembly_name as base_assembly from e join symbols m on m.symbol_id = e.member_id join symbols b on b.symbol_id = e.base_id where b.assembly_name <> 'Brand#5'",
)
def _(spark, sf_dir):
    """Several interface members for each member; those of an assembly that is not there are left out, the others stay."""
    parts = td.read(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.lit(2), F.lit(3), F.lit(1000))).alias("k"))
    edges = parts.select(_key(F.col("p_partkey")).alias("member_id"), _key(F.expr("p_partkey div k")).alias("base_id"))
    found = refs_.interface_members(edges, td.symbols(spark, sf_dir))
    return found.filter("base_assembly <> 'Brand#5'").select("member_id", "base_id", "member", "base", "base_assembly")


@query("code_references", f"with {td.REFS_SQL} select to_assembly, count(*) as n from refs where to_assembly not in ('NATION_1', 'NATION_2') group by 1")
def _(spark, sf_dir):
    """References to lists in place of code do not count; two nations stand for such lists."""
    r = td.references(spark, sf_dir)
    named = r.withColumn("to_assembly", F.when(r["to_assembly"] == "NATION_1", PSEUDO_ASSEMBLIES[0]).when(r["to_assembly"] == "NATION_2", PSEUDO_ASSEMBLIES[4]).otherwise(r["to_assembly"]))
    return refs_.code_only(named).groupBy("to_assembly").agg(F.count(F.lit(1)).alias("n"))


@query("indexed_edges", f"with {td.EDGES_SQL} select 'all' as list, from_assembly, to_assembly from edges union all select 'some', from_assembly, to_assembly from edges join nation on n_name = to_assembly where n_nationkey < 4")
def _(spark, sf_dir):
    e = td.assembly_edges(spark, sf_dir)
    some = td.read(spark, sf_dir, "nation").filter("n_nationkey < 4").select(F.col("n_name").alias("assembly"))
    of = lambda name, rows: rows.select(F.lit(name).alias("list"), "from_assembly", "to_assembly")
    return of("all", graph.indexed_only(e, None)).unionByName(of("some", graph.indexed_only(e, some)))


@query("used_by", f"with {td.EDGES_SQL} select to_assembly as assembly, cast(row_number() over (partition by to_assembly order by {fold_sql('from_assembly')}, from_assembly) - 1 as int) as position, from_assembly as referencing from edges")
def _(spark, sf_dir):
    return graph.used_by(td.assembly_edges(spark, sf_dir))


@query("processed_order", f"select a as assembly, row_number() over (order by {fold_sql('a')}, a) - 1 as line from (select case when n_nationkey % 2 = 0 then lower(n_name) else n_name end as a from nation) t")
def _(spark, sf_dir):
    n = td.read(spark, sf_dir, "nation")
    return graph.processed_order(n.select(F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("assembly")))


@query("interface_implementations", "select t.p_partkey as type_id, i.r_regionkey as interface_id, i.r_name as interface_member, t.p_name as implementation from part t join region i on t.p_size % 5 = i.r_regionkey and t.p_partkey % 5 in (i.r_regionkey, (i.r_regionkey + 1) % 5)")
def _(spark, sf_dir):
    """Types implement two interfaces; a member does so where its signature is the interface member's."""
    p, r = td.read(spark, sf_dir, "part"), td.read(spark, sf_dir, "region")
    own = p.select(F.col("p_partkey").alias("type_id"), F.col("p_name").alias("member_id"), (F.col("p_size") % 5).alias("signature"))
    asked = r.select(F.col("r_regionkey").alias("type_id"), F.col("r_name").alias("member_id"), F.col("r_regionkey").alias("signature"))
    of = p.select(F.col("p_partkey").alias("type_id"), F.explode(F.array(F.col("p_partkey") % 5, (F.col("p_partkey") + 4) % 5)).alias("interface_id"))
    return extract.implementations(asked, own, of)


_LINES = "l as (select doc_id, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as int) as line, unnest(string_split(text, chr(10))) as t from documents where doc_id is not null and text is not null), st as (select doc_id, line, t, cast(coalesce(sum(length(t) + 1) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) as bigint) as start from l), w as (select doc_id, line, start, t, regexp_extract(t, '[a-z]{4,}') as word from st)"


def _words(spark, sf_dir):
    """The first word of four plain letters of each line, with where it starts in its document."""
    docs = td.read(spark, sf_dir, "documents").filter("doc_id is not null and text is not null")
    lines = spans.line_starts(docs, "doc_id", "text")
    word = lines.withColumn("word", F.regexp_extract("line_text", "[a-z]{4,}", 0)).filter("word <> ''")
    at = F.col("start") + F.instr(F.col("line_text"), F.col("word")) - 1
    return word.select("doc_id", at.alias("start"), F.length("word").alias("len")), lines


@query("span_lines", f"with {_LINES} select doc_id, start + instr(t, word) - 1 as start, line, length(t) as chars from w where word <> ''")
def _(spark, sf_dir):
    words, lines = _words(spark, sf_dir)
    return extract.lines_of_spans(words, lines, "doc_id").select("doc_id", "start", "line", F.length("line_text").cast("long").alias("chars"))


_E = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), {q}, '&#39;')".replace("{q}", "''''")


@query(
    "reference_rows",
    f"""with {_LINES}, r as (select doc_id, start + instr(t, word) - 1 as start, line + 1 as line, trim(t, ' ') as b, instr(t, word) - 1 - (length(t) - length(ltrim(t, ' '))) as a, length(word) as n from w where word <> '')
select doc_id, start, line, md5({_E.format("b")}) as html_md5, cast(case when a > 0 then length({_E.format("substr(b, 1, a)")}) else a end as int) as col_start, cast(length({_E.format("substr(b, 1, a + n)")}) as int) as col_end from r""",
)
def _(spark, sf_dir):
    """Tokens with the number and the escaped text of their line, and their columns in it."""
    words, lines = _words(spark, sf_dir)
    rows = extract.reference_rows(words, lines, "doc_id")
    return rows.select("doc_id", "start", "line", F.md5(F.col("line_html").cast("binary")).alias("html_md5"), "col_start", "col_end")


@query("blamed_lines", "select e.event_id, e.user_id as path, e.event_id % 40 as line, b.event_type as commit from events e left join (select user_id, event_id % 40 as line, min(event_type) as event_type from events where event_id % 7 = 0 group by 1, 2) b on b.user_id = e.user_id and b.line = e.event_id % 40")
def _(spark, sf_dir):
    """Lines with the commit of the hunk that begins there."""
    e = td.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("path"), (F.col("event_id") % 40).alias("line"), "event_type")
    hunks = e.filter("event_id % 7 = 0").groupBy("path", "line").agg(F.min("event_type").alias("commit"))
    return spans.blame(e.drop("event_type"), hunks).select("event_id", "path", "line", "commit")


@query("constructor_references", "select count(*) as n, count(*) filter (where kind = 5) as made from (select l_partkey, 8 as kind from lineitem union all select l_partkey // 2, 5 from lineitem where l_partkey % 4 = 0) t")
def _(spark, sf_dir):
    refs = td.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("to_symbol_id"), F.lit(8).alias("kind"))
    made = td.read(spark, sf_dir, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("symbol_id"), F.expr("p_partkey div 2").alias("type_id"))
    both = refs_.constructor_references(refs, made)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == 5).alias("made"))


@query("partial_pages", "select l_partkey, string_agg(f, ',' order by f) as files from (select distinct l_partkey, 'F' || (l_orderkey % 50) || '.cs' as f from lineitem) t group by 1 having count(*) > 1")
def _(spark, sf_dir):
    """Files of symbols that stand in several, in the order of their paths without extension (here that of the paths)."""
    line = td.read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    pages = hierarchy.partial_pages(line, "l_partkey", F.concat(F.lit("F"), (F.col("l_orderkey") % 50).cast("string"), F.lit(".cs")))
    return pages.select("l_partkey", F.array_join(F.sort_array("files"), ",").alias("files"))


@query("plugin_settings", "select p_brand as plugin, string_agg(p_type || '=' || v, ',' order by p_type) as settings from (select p_brand, p_type, arg_max(p_name, p_partkey) as v from part where p_size % 9 <> 0 group by 1, 2) t group by 1")
def _(spark, sf_dir):
    """Settings by plug-in, the last line of a key; lines of another form do not count."""
    line = F.when(F.col("p_size") % 9 == 0, F.col("p_name")).otherwise(F.concat("p_brand", F.lit(":"), "p_type", F.lit("="), "p_name"))
    maps = stats.settings(td.read(spark, sf_dir, "part").select(line.alias("line"), "p_partkey"), "p_partkey")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("settings")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return maps.select("plugin", shown.alias("settings"))


@query("first_by_path_and_stem", "select p_partkey from (select p_partkey, row_number() over (partition by p_name order by p_partkey) as rn from part) t where rn = 1")
def _(spark, sf_dir):
    """Projects of one name in different folders, and twice in one."""
    path = F.concat(F.lit("/src/"), "p_brand", F.lit("/"), "p_name", F.lit(".csproj"))
    return selection.first_by_path_and_stem(td.read(spark, sf_dir, "part").select("p_partkey", path.alias("path")), "path", "p_partkey").select("p_partkey")


@query(
    "project_files",
    """with f as (select p_partkey, p_brand as project, p_partkey % 3 as k, p_name || p_partkey as n from part),
x as (select *, row_number() over (partition by project order by '/ext/' || n) as rn from f where k = 2)
select project, n as include, null as link from f where k = 0 union all select project, '../../lib/' || n, 'lib/' || n from f where k = 1 union all select project, '../../../_external/' || rn || '/' || n, null from x""",
)
def _(spark, sf_dir):
    """Sources of a project: its own, linked ones of the repository, and external ones."""
    n, k = F.concat("p_name", F.col("p_partkey").cast("string")), F.col("p_partkey") % 3
    file = F.when(k == 0, F.concat(F.lit("/repo/src/p/"), n)).when(k == 1, F.concat(F.lit("/repo/lib/"), n)).otherwise(F.concat(F.lit("/ext/"), n))
    rows = td.read(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), F.lit("/repo/src/p").alias("directory"), F.lit("/repo").alias("root"), file.alias("file"))
    return selection.project_files(rows)


@query(
    "namespace_outline",
    """with t as (select distinct p_brand || '.' || p_type as ns, split_part(p_name, ' ', 1) as name from part),
s as (select distinct p_brand as path, cast(null as varchar) as parent, p_brand as title, 1 as depth from part union select distinct p_brand || '.' || p_type, p_brand, p_type, 2 from part),
u as (select path, parent, title, depth, false as is_type, title as sort_title from s union all select ns || '.' || name, ns, name, 3, true, '{' || name from t)
select * from u""",
)
def _(spark, sf_dir):
    types = td.read(spark, sf_dir, "part").select(F.concat_ws(".", "p_brand", "p_type").alias("ns"), F.substring_index("p_name", " ", 1).alias("name"))
    return hierarchy.namespace_outline(types, "ns", "name")


@query("placed_folders", f"with n as (select distinct p_brand as parent, case when p_type = 'SMALL' then 'Properties' else p_type end as title from part) select parent, title, row_number() over (partition by parent order by case when upper(title) = 'PROPERTIES' then 0 else 1 end, {fold_sql('title')}, title) as position from n")
def _(spark, sf_dir):
    title = F.when(F.col("p_type") == "SMALL", "Properties").otherwise(F.col("p_type"))
    return hierarchy.placed(td.read(spark, sf_dir, "part").select(F.col("p_brand").alias("parent"), title.alias("title")).distinct())


@query("nesting_depth", "select p_partkey, cast(p_size % 3 as int) as depth from part")
def _(spark, sf_dir):
    inner = F.concat("p_type", F.repeat(F.lit(".Inner"), F.col("p_size") % 3))
    return td.read(spark, sf_dir, "part").select("p_partkey", hierarchy.nesting_depth(F.concat_ws(".", "p_brand", inner), F.col("p_brand")).alias("depth"))


#: Lines of an order as ranges of one text: overlapping, nested, equal and empty ones of both analyses, some with links.
_RANGES = """r as (select l_orderkey as doc, cast(l_linenumber * 3 % 11 as bigint) as start, cast(l_partkey % 6 as bigint) as len,
  (['keyword', 'text', 'comment', 'type', 'string'])[l_suppkey % 5 + 1] as class, l_linestatus = 'F' and l_partkey % 2 = 0 as semantic, case when l_partkey % 3 = 0 then 'u' || l_partkey end as link, cast(l_linenumber as bigint) as seq from lineitem),
 f as (select *, start + len as stop from r where len > 0),
 cut as (select doc, b as start, lead(b) over (partition by doc order by b) as stop from (select distinct doc, unnest([start, stop]) as b from f) t),
 piece as (select c.doc, c.start, c.stop, f.class, f.link, f.seq, f.semantic and f.start = c.start and f.stop = c.stop as sem, f.start as from_, f.semantic as whole, f.stop as till from cut c join f on f.doc = c.doc and f.start <= c.start and f.stop >= c.stop)"""


def _range_rows(spark, sf_dir):
    k, p = F.col("l_linenumber"), F.col("l_partkey")
    cls = F.element_at(F.array(*map(F.lit, ("keyword", "text", "comment", "type", "string"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    semantic = (F.col("l_linestatus") == "F") & (p % 2 == 0)
    return td.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (k * 3 % 11).cast("long").alias("start"), (p % 6).alias("len"), cls.alias("class"), semantic.alias("semantic"), F.when(p % 3 == 0, F.concat(F.lit("u"), p.cast("string"))).alias("link"), k.cast("long").alias("seq"))


@query("origin_pieces", f"with {_RANGES} select doc, start, stop - start as len, class, link, seq from piece")
def _(spark, sf_dir):
    """Every piece with the range it comes from."""
    return ranges.origin_pieces(_range_rows(spark, sf_dir), "doc")


@query(
    "prepared_ranges",
    f"""with {_RANGES},
listed as (select doc, start, stop, list({{'s': sem, 'c': class, 'h': link}} order by from_, whole, seq, till, class, link) as l from piece group by doc, start, stop),
best as (select doc, start, stop, list_reduce(l, lambda a, b: case
  when a.s <> b.s then {{'s': false, 'c': case when a.s then a.c else b.c end, 'h': case when a.s then b.h else a.h end}}
  when b.c = 'comment' then {{'s': a.s, 'c': case when a.c = 'text' then b.c else a.c end, 'h': coalesce(a.h, b.h)}}
  else {{'s': b.s, 'c': case when b.c = 'text' then a.c else b.c end, 'h': coalesce(b.h, a.h)}} end) as x from listed),
shown as (select doc, start, stop, x.c as class, x.h as link from best),
docs as (select o_orderkey as doc, cast(20 as bigint) as total from orders),
gap as (select doc, coalesce(lag(stop) over (partition by doc order by start), 0) as start, start as stop from shown
  union all select d.doc, coalesce(m, 0), total from docs d left join (select doc, max(stop) as m from shown group by doc) t using (doc))
select doc, start, stop - start as len, class, link from shown union all select doc, start, stop - start, null, null from gap where stop > start""",
)
def _(spark, sf_dir):
    """Ranges of both analyses cut and chosen from with their links, and the gaps between them."""
    docs = td.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(20).alias("total"))
    return ranges.prepared(docs, _range_rows(spark, sf_dir), "doc", "total")


_PIPE = "s as (select user_id, event_id * 10 as start, cast(event_id % 7 + 1 as bigint) as len, event_type in ('click', 'view') as kw from events)"


@query(
    "classified_spans",
    f"""with {_PIPE}, b as (select *, case when kw and coalesce(lag(kw) over (partition by user_id order by start), false) then 0 else 1 end as b from s),
i as (select *, sum(b) over (partition by user_id order by start) as island from b),
m as (select user_id, min(start) as start, max(start + len) - min(start) as len, bool_or(kw) as kw from i group by user_id, island),
g as (select *, coalesce(lag(start + len) over (partition by user_id order by start), 0) as before from m), e as (select user_id, max(start + len) as last from m group by 1)
select user_id, start, len, case when kw then 'k' else 'i' end as style from m union all select user_id, before, start - before, null from g where start > before union all select user_id, last, 2000000 - last, null from e where last < 2000000""",
)
def _(spark, sf_dir):
    """Tokens of a text: neighbouring keywords merged, classes mapped to styles, and gaps filled."""
    e = td.read(spark, sf_dir, "events")
    s = e.select("user_id", (F.col("event_id") * 10).alias("start"), (F.col("event_id") % 7 + 1).alias("len"), F.col("event_type").isin("click", "view").alias("kw"))
    classed = dealt(s, "user_id").withColumn("class", F.when(F.col("kw"), "keyword").otherwise("identifier"))
    merged = spans.merge_runs(classed, "user_id", "kw", "start", "class")
    styled = merged.withColumn("style", extract.style(F.col("class"))).withColumn("total", F.lit(2000000).cast("long"))
    return spans.fill_gaps(styled, "user_id", "total", "style").select("user_id", "start", "len", "style")


@query("folded_order", f"select assembly_name, row_number() over (order by {fold_sql('assembly_name')}, assembly_name) as position from (select distinct p_brand as assembly_name from part) t")
def _(spark, sf_dir):
    brands = td.read(spark, sf_dir, "part").select(F.col("p_brand").alias("assembly_name")).distinct()
    return numbering.folded_order(brands, "assembly_name", "position").withColumn("position", F.col("position") + 1)


@query(
    "explorer_order",
    """with t as (select distinct p_brand as b, p_type as t, split_part(p_name, ' ', 1) as n from part),
u as (select b as path, 1 as depth, [upper(b)] as k from t union select b || '.' || t, 2, [upper(b), upper(t)] from t union select b || '.' || t || '.' || n, 3, [upper(b), upper(t), '{' || upper(n)] from t),
s as (select path, depth, k, count(*) over () as total from u)
select path, cast(depth - 1 as int) as depth, cast(row_number() over (order by k) - 1 as bigint) as enter,
       row_number() over (order by k) - 1 + (select count(*) from u d where d.path = s.path or starts_with(d.path, s.path || '.')) as leave from s""",
)
def _(spark, sf_dir):
    """Namespaces and types in the order of the explorer's page, each with where its nodes begin and end."""
    types = td.read(spark, sf_dir, "part").select(F.concat_ws(".", "p_brand", "p_type").alias("ns"), F.substring_index("p_name", " ", 1).alias("name"))
    nodes = hierarchy.namespace_outline(types, "ns", "name").select(F.col("path").alias("node"), "parent", F.col("sort_title").alias("title"))
    return hierarchy.nested_order(nodes).select(F.col("node").alias("path"), F.col("depth").cast("int").alias("depth"), "enter", "leave")


_TREE = "t as (select p_partkey as node, case when p_partkey % 4 > 0 then p_partkey - 1 end as parent, split_part(p_name, ' ', 1) as name from part)"


@query("qualified_names", f"with recursive {_TREE}, c(node, up, q, depth) as (select node, parent, name, 0 from t union all select c.node, t.parent, t.name || '.' || c.q, c.depth + 1 from c join t on c.up = t.node) select node, arg_max(q, depth) as qualified, cast(max(depth) as int) as depth from c group by node")
def _(spark, sf_dir):
    """Chains of up to four declarations."""
    k = F.col("p_partkey")
    nodes = td.read(spark, sf_dir, "part").select(k.alias("node"), F.when(k % 4 > 0, k - 1).alias("parent"), F.substring_index("p_name", " ", 1).alias("name"))
    return closure.qualified_names(nodes)


@query("redirect_dictionary", f"with {td.REFS_SQL}, r as (select substr(to_symbol_id, 1, 1) as bucket, min(from_path) as file from refs where kind = 3 group by to_symbol_id having count(distinct upper(from_path)) = 1) select bucket, file, cast(row_number() over (partition by bucket order by file) - 1 as int) as number from (select distinct bucket, file from r) t")
def _(spark, sf_dir):
    places = td.references(spark, sf_dir).filter("kind = 3").select(F.col("to_symbol_id").alias("symbol_id"), F.col("from_path").alias("file"))
    return search.redirect_dictionary(search.redirects(places))


@query(
    "followed_redirects",
    f"with {td.REFS_SQL}, r as (select to_symbol_id as s, case when count(distinct upper(from_path)) = 1 then min(from_path) else 'partial/' || to_symbol_id end as page from refs where kind = 3 group by to_symbol_id) select substr(md5('T:' || p_partkey), 1, 16) as symbol_id, page from part left join r on s = substr(md5('T:' || p_partkey), 1, 16)",
)
def _(spark, sf_dir):
    """The page of every symbol: that of its file, one for several files, or none."""
    places = td.references(spark, sf_dir).filter("kind = 3").select(F.col("to_symbol_id").alias("symbol_id"), F.col("from_path").alias("file"))
    return search.follow_redirects(td.read(spark, sf_dir, "part").select(_key(F.col("p_partkey")).alias("symbol_id")), search.redirects(places))
