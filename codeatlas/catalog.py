"""All queries over the driver's tables, with the DuckDB text of each.

A query is registered by name beside the SQL that must give the same rows.  What a
name does is told by the operator it calls.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from .functions import ids, kinds, text
from .functions.folding import fold, fold_sql
from .operators import batch_search, closure, graph, hierarchy, numbering, references as refs_, search, selection, spans, stats
from .registered import oracle_sql, queries, query  # noqa: F401
from .runtime import dealt
from .sources import testdata as td
from .streaming import builds

# ---------------------------------------------------------------- search


def _branch(where: str, term: str) -> str:
    """One interpretation in SQL: first 100 in index order, then its match level."""
    level = f"case when name = '{term}' then 1 when name_fold = {fold_sql(f"'{term}'")} then 2 when starts_with(name, '{term}') then 3 else 4 end"
    return f"(select *, {level} as match_level from (select * from symbols where {where} order by name_fold, kind_rank, name, assembly_number, symbol_id limit 100) x)"


_FOUND = "select name, kind, assembly_name, symbol_id, match_level, match_level * 10 + kind_rank as weight from "


def _search(name: str, text_: str, *branches: tuple[str, str]) -> None:
    sql = f"with {td.SYMBOLS_SQL} {_FOUND} (" + " union all ".join("select * from " + _branch(*b) + f" b{k}" for k, b in enumerate(branches)) + ") u"

    @query(name, sql)
    def run(spark, sf_dir):
        found = search.search_symbols(td.symbols(spark, sf_dir), text_)
        return found.select("name", "kind", "assembly_name", "symbol_id", "match_level", "weight")

    return sql


_word = lambda w: f"(contains(name_fold, '{w}') or contains(assembly_fold, '{w}') or contains(project_fold, '{w}'))"
_search("search_prefix", "col", ("starts_with(name_fold, 'COL')", "col"))
_search("search_verbatim", '"cold widget"', ("name_fold = 'COLD WIDGET'", "cold widget"))
_search("search_words_and", "cold widget", (f"starts_with(name_fold, 'COLD') and {_word('WIDGET')}", "cold"), (f"starts_with(name_fold, 'WIDGET') and {_word('COLD')}", "widget"))
_search("search_union_all_interpretations", "lar large", (f"starts_with(name_fold, 'LAR') and {_word('LARGE')}", "lar"), (f"starts_with(name_fold, 'LARGE') and {_word('LAR')}", "large"))
_search("search_short_word", "red ri", (f"starts_with(name_fold, 'RED') and {_word('RI')}", "red"))
_search("search_dotted_namespace", "ECONOMY.small", ("starts_with(name_fold, 'SMALL') and contains(desc_fold, 'ECONOMY.SMALL')", "small"))
_search("search_dotted_filter", "cold Brand#2.", (f"starts_with(name_fold, 'COLD') and (contains(assembly_fold, 'BRAND#2.') or contains(desc_fold, 'BRAND#2.'))", "cold"), ("starts_with(name_fold, 'BRAND#2.')", "Brand#2."))
_search("search_kind_type", "cold type", ("starts_with(name_fold, 'COLD') and kind in ('class','struct','interface','enum','delegate')", "cold"))
_search("search_kind_any", "cold method property", ("starts_with(name_fold, 'COLD') and kind in ('method','property')", "cold"))
_search("search_path_filter", "small src\\Brand#1", ("starts_with(name_fold, 'SMALL') and contains(project_fold, 'SRC\\BRAND#1')", "small"))
_search("search_accessor", "get_cold", ("starts_with(name_fold, 'GET_COLD')", "get_cold"), ("starts_with(name_fold, 'COLD')", "cold"))
_search("search_file_name", "small.cs", ("starts_with(name_fold, 'SMALL.CS')", "small.cs"))


@query(
    "search_batch",
    f"""with {td.SYMBOLS_SQL}, q as (select distinct p_name as query, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from part),
r as (select query, 0 as reading, a as term, case when a <> b then b end as word, null as ns from q union all select query, 1, b, a, null from q where a <> b
  union all select query, 0, query, null, null from (select distinct '"' || p_name || '"' as query from part) t
  union all select distinct p_type || '.' || split_part(p_name, ' ', 1), 0, split_part(p_name, ' ', 1), null, p_type || '.' || split_part(p_name, ' ', 1) from part),
t as (select query, reading, case when starts_with(term, '"') then substr(term, 2, length(term) - 2) else term end as term, starts_with(term, '"') as whole, word, ns from r),
m as (select t.*, s.*, row_number() over (partition by query, reading order by name_fold, kind_rank, name, assembly_number, symbol_id) as rn from t join symbols s
  on case when whole then name_fold = {fold_sql('term')} else starts_with(name_fold, {fold_sql('term')}) end
  and (word is null or contains(name_fold, {fold_sql('word')}) or contains(assembly_fold, {fold_sql('word')}) or contains(project_fold, {fold_sql('word')})) and (ns is null or contains(desc_fold, {fold_sql('ns')})))
select query, reading, symbol_id, case when name = term then 1 when name_fold = {fold_sql('term')} then 2 when starts_with(name, term) then 3 else 4 end as match_level from m where rn <= 100""",
)
def _(spark, sf_dir):
    """Every part's name as a query, plain and quoted, and its type with the first word as a dotted one."""
    p = td.read(spark, sf_dir, "part")
    texts = p.select(F.explode(F.array("p_name", F.concat(F.lit('"'), "p_name", F.lit('"')), F.concat("p_type", F.lit("."), F.substring_index("p_name", " ", 1)))).alias("query")).distinct()
    found = batch_search.search_many(td.symbols(spark, sf_dir), texts.withColumn("text", F.col("query")))
    return found.select("query", "reading", "symbol_id", "match_level")


@query("potential_results", f"with {td.SYMBOLS_SQL} select 0 as interpretation, count(*) as n from symbols where starts_with(name_fold, 'COLD') union all select 1, count(*) from symbols where starts_with(name_fold, 'WIDGET')")
def _(spark, sf_dir):
    return search.potential_results(td.symbols(spark, sf_dir), "cold widget")


@query(
    "results_grouped_by_assembly",
    f"""with {td.SYMBOLS_SQL}, {td.REFS_SQL},
r as (select assembly_name, count(distinct from_assembly) as n from refs join symbols on symbol_id = to_symbol_id group by 1),
g as (select assembly_name, min(weight) as best, count(*) as n from ({_FOUND} {_branch("starts_with(name_fold, 'COLD')", 'cold')} b) f group by assembly_name),
c as (select g.*, coalesce(r.n, 0) as referencing from g left join r using (assembly_name))
select *, row_number() over (order by best, referencing desc, {fold_sql("assembly_name")}) as rank from c""",
)
def _(spark, sf_dir):
    s = td.symbols(spark, sf_dir)
    used = td.references(spark, sf_dir).select(F.col("to_symbol_id").alias("symbol_id"), "from_assembly").join(s.select("symbol_id", "assembly_name"), "symbol_id")
    referencing = used.groupBy(F.col("assembly_name").alias("assembly")).agg(F.countDistinct("from_assembly").alias("n"))
    return search.group_by_assembly(search.search_symbols(s, "cold"), referencing)


_ASSEMBLIES, _keyed = td.ASSEMBLIES_SQL, td.keyed


@query("project_keys", f"with {_ASSEMBLIES} select assembly_name, project_path, project_key from keyed")
def _(spark, sf_dir):
    return numbering.project_keys(td.assemblies(spark, sf_dir))


@query("assembly_search", f"with {_ASSEMBLIES} select assembly_name, project_key from keyed where project_key <> -1 and starts_with(upper(assembly_name), 'BRAND#1') order by upper(assembly_name) limit 100")
def _(spark, sf_dir):
    return search.search_assemblies(_keyed(spark, sf_dir), "brand#1").select("assembly_name", "project_key")


@query("project_search", f"with {_ASSEMBLIES} select project_path, assembly_name from keyed where starts_with(upper(project_path), 'SRC/BRAND#2') order by upper(project_path) limit 100")
def _(spark, sf_dir):
    k = _keyed(spark, sf_dir)
    return search.search_projects(k.filter("project_key <> -1").select("project_key", "project_path"), k.filter("project_key <> -1"), "src/brand#2").select("project_path", "assembly_name")


@query("name_list_search", "select name from (select distinct p_name as name from part) t where starts_with(name, 'hot') order by name limit 100")
def _(spark, sf_dir):
    return search.search_names(td.read(spark, sf_dir, "part"), "p_name", "hot")


_GUID = "substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21,12)"


@query("guid_search", f"select g as name from (select distinct {_GUID} as g from (select md5(cast(p_partkey as varchar)) as h from part) t) u where starts_with(g, 'a') order by g limit 100")
def _(spark, sf_dir):
    g = td.read(spark, sf_dir, "part").select(text.canonical_guid(F.md5(F.col("p_partkey").cast("string").cast("binary"))).alias("g"))
    return search.search_names(g, "g", search.guid_prefix("{A})"))


@query("find_assembly", "select distinct p_brand as assembly_name from part where p_brand = (select min(p_brand) from part where starts_with(p_brand, 'Brand#1'))")
def _(spark, sf_dir):
    return search.find_first(td.assemblies(spark, sf_dir).select("assembly_name"), "assembly_name", "brand#1")


_TERMS = "select case when p_partkey % 2 = 0 then 'T:' || p_partkey else substr(md5('T:' || p_partkey), 1, 16) end as term, substr(md5('T:' || p_partkey), 1, 16) as symbol_id from part union all select 'T:none', substr(md5('T:none'), 1, 16)"


@query("symbol_by_id", f"with {td.SYMBOLS_SQL}, terms as ({_TERMS}) select term, t.symbol_id, '/' || s.assembly_name || '/A.html#' || t.symbol_id as url from terms t left join symbols s on s.symbol_id = t.symbol_id")
def _(spark, sf_dir):
    named = F.concat(F.lit("T:"), F.col("p_partkey").cast("string"))
    terms = td.read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, named).otherwise(ids.symbol_id(named)).alias("term"))
    return search.symbol_urls(td.symbols(spark, sf_dir), terms.unionByName(spark.createDataFrame([("T:none",)], "term string")))


@query("symbol_id_forms", "select p_partkey, substr(md5('T:' || p_partkey), 1, 16) as symbol_id, true as same, substr(md5('f.ts|' || p_partkey), 1, 16) as positional from part")
def _(spark, sf_dir):
    hexed = ids.symbol_id(F.concat(F.lit("T:"), F.col("p_partkey").cast("string")))
    return td.read(spark, sf_dir, "part").select("p_partkey", hexed.alias("symbol_id"), (ids.decimal_to_id(ids.id_to_decimal(hexed)) == hexed).alias("same"), ids.positional_id(F.lit("f.ts"), F.col("p_partkey")).alias("positional"))


@query(
    "redirect_buckets",
    f"with {td.REFS_SQL} select substr(to_symbol_id, 1, 1) as bucket, substr(to_symbol_id, 2, 7) as key, to_symbol_id as symbol_id, count(distinct upper(from_path)) as files, case when count(distinct upper(from_path)) = 1 then min(from_path) end as file from refs group by to_symbol_id",
)
def _(spark, sf_dir):
    return search.redirects(td.references(spark, sf_dir).select(F.col("to_symbol_id").alias("symbol_id"), F.col("from_path").alias("file")))


_GLYPH_KIND = "case " + " ".join(f"when glyph between {a} and {b} then '{kind}'" for kind, ranges in kinds.GLYPH_RANGES.items() for a, b in ranges) + " else 'symbol' end"


@query(
    "symbol_materialize",
    f"""with {td.SYMBOLS_SQL}, {_ASSEMBLIES}, packed as (select symbol_id, assembly_number, cast(('0x' || substr(symbol_id, 1, 4))::bigint % 230 as int) as glyph from symbols),
m as (select p.symbol_id, k.assembly_name, k.project_path, {_GLYPH_KIND} as kind from packed p join keyed k on k.assembly_number = p.assembly_number)
select *, case when kind in ('class','struct','interface','enum','delegate') then 1 when kind = 'field' then 3 when kind = 'file' then 4 else 2 end as kind_rank from m""",
)
def _(spark, sf_dir):
    glyph = (F.conv(F.substring("symbol_id", 1, 4), 16, 10).cast("int") % 230).alias("glyph")
    packed = td.symbols(spark, sf_dir).select("assembly_number", glyph, "name", "symbol_id", "description")
    k = _keyed(spark, sf_dir)
    return search.materialize(packed, k, k.select("project_key", "project_path")).select("symbol_id", "assembly_name", "project_path", "kind", "kind_rank")


# ---------------------------------------------------------------- references


@query(
    "refs_by_kind_assembly_file_line",
    f"with {td.REFS_SQL} select to_symbol_id, kind, from_assembly, from_path, line, count(*) as n, string_agg(col_start || '-' || col_end, ',' order by col_start, col_end) as occurrences from refs group by all",
)
def _(spark, sf_dir):
    shown = F.array_join(F.transform("occurrences", lambda o: F.concat_ws("-", o["col_start"].cast("string"), o["col_end"].cast("string"))), ",")
    return refs_.lines(td.references(spark, sf_dir)).withColumn("occurrences", shown)


@query("refs_rollup_counts", f"with {td.REFS_SQL} select kind, from_assembly, from_path, count(*) as n, cast(grouping(kind, from_assembly, from_path) as bigint) as level from refs group by rollup(kind, from_assembly, from_path)")
def _(spark, sf_dir):
    return refs_.counts(td.references(spark, sf_dir))


@query("refs_first_name", f"with {td.REFS_SQL} select to_symbol_id, min_by(to_name, seq) filter (where to_name <> 'base') as name from refs group by to_symbol_id")
def _(spark, sf_dir):
    return refs_.display_names(td.references(spark, sf_dir))


# Reference kinds in words.
_WORDS = "['derived type', 'interface inheritance', 'interface implementation', 'override', 'interface member implementation', 'instantiation', 'write', 'read', 'reference', 'guid usage', 'empty array allocation', 'MSBuild property assignment', 'MSBuild property usage', 'MSBuild item assignment', 'MSBuild item usage', 'MSBuild target declaration', 'MSBuild target usage', 'MSBuild task declaration', 'MSBuild task usage']"


@query("refs_headers", f"with {td.REFS_SQL} select to_symbol_id, kind, count(*) as n, count(*) || ' ' || ({_WORDS})[kind + 1] || case when count(*) = 1 then '' else 's' end as header from refs group by to_symbol_id, kind")
def _(spark, sf_dir):
    return refs_.headers(td.references(spark, sf_dir))


@query("unreferenced_symbols", "select substr(md5('T:' || p.p_partkey), 1, 16) as symbol_id, p_size as \"offset\" from part p where p_size <> 0 and not exists (select 1 from lineitem l where l.l_partkey = p.p_partkey and l.l_returnflag = 'R' and l.l_quantity > 40)")
def _(spark, sf_dir):
    places = td.read(spark, sf_dir, "part").select(ids.symbol_id(F.concat(F.lit("T:"), F.col("p_partkey").cast("string"))).alias("symbol_id"), F.col("p_size").alias("offset"))
    used = td.read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 40").select(ids.symbol_id(F.concat(F.lit("T:"), F.col("l_partkey").cast("string"))).alias("to_symbol_id"))
    return refs_.unreferenced(places, used)


@query("base_member_join", f"with {td.SYMBOLS_SQL}, e as (select substr(md5('T:' || p_partkey), 1, 16) as member_id, substr(md5('T:' || (p_partkey // 2)), 1, 16) as base_id from part) select e.member_id, e.base_id, m.name as member, b.name as base, b.assembly_name as base_assembly from e join symbols m on m.symbol_id = e.member_id join symbols b on b.symbol_id = e.base_id")
def _(spark, sf_dir):
    key = lambda c: ids.symbol_id(F.concat(F.lit("T:"), c.cast("string")))
    edges = td.read(spark, sf_dir, "part").select(key(F.col("p_partkey")).alias("member_id"), key(F.expr("p_partkey div 2")).alias("base_id"))
    return refs_.base_members(edges, td.symbols(spark, sf_dir)).select("member_id", "base_id", "member", "base", "base_assembly")


@query("partial_symbols", "select l_partkey, count(distinct o_orderkey % 50) as files from lineitem l join orders o on l.l_orderkey = o.o_orderkey where l_returnflag = 'R' and l_quantity > 40 group by l_partkey having count(distinct o_orderkey % 50) > 1")
def _(spark, sf_dir):
    line = td.read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 40").select("l_partkey", "l_orderkey")
    orders = td.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return hierarchy.partial_symbols(line.join(orders, "l_orderkey"), "l_partkey", F.col("l_orderkey") % 50)


@query("local_ids", "with t as (select user_id, event_type, min(event_id) as first from events group by 1, 2) select user_id, event_type, first, cast(dense_rank() over (partition by user_id order by first) - 1 as int) as local_id from t")
def _(spark, sf_dir):
    return refs_.local_ids(td.read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


@query("highlight_links", f"with {td.REFS_SQL} select line, col_start, col_end from refs where from_path = 'f1.cs' and to_symbol_id = substr(md5('T:' || (select min(l_partkey) from lineitem where l_orderkey % 50 = 1)), 1, 16)")
def _(spark, sf_dir):
    part = td.read(spark, sf_dir, "lineitem").filter("l_orderkey % 50 = 1").agg(F.min("l_partkey")).first()[0]
    return refs_.highlight(td.references(spark, sf_dir), "f1.cs", hashlib.md5(f"T:{part}".encode()).hexdigest()[:16])


# ---------------------------------------------------------------- graph


_COUNTED = f"{td.EDGES_SQL}, counted as (select n_name as assembly, count(distinct from_assembly) as n from nation left join edges on to_assembly = n_name group by n_name)"


def _counted(spark, sf_dir):
    return graph.referencing_counts(td.assembly_edges(spark, sf_dir), td.read(spark, sf_dir, "nation").select(F.col("n_name").alias("assembly")))


@query("referencing_counts", f"with {_COUNTED} select assembly, n from counted")
def _(spark, sf_dir):
    return _counted(spark, sf_dir)


@query("top_referenced", f"with {_COUNTED} select assembly, n from counted order by n desc, {fold_sql('assembly')}, assembly limit 100")
def _(spark, sf_dir):
    return graph.top_referenced(_counted(spark, sf_dir))


@query("referencing_lists_lt_100", f"with {td.EDGES_SQL} select to_assembly, count(distinct from_assembly) as n, string_agg(from_assembly, ',' order by from_assembly) as referencing from edges group by to_assembly having count(distinct from_assembly) < 100")
def _(spark, sf_dir):
    return graph.referencing_lists(td.assembly_edges(spark, sf_dir))


@query("used_references", f"with {td.EDGES_SQL} select from_assembly, to_assembly from edges union select n_name, 'forwarded' from nation where n_nationkey < 3")
def _(spark, sf_dir):
    forwards = td.read(spark, sf_dir, "nation").filter("n_nationkey < 3").select(F.col("n_name").alias("assembly"), F.lit("forwarded").alias("to_assembly"))
    return graph.used_references(td.references(spark, sf_dir), forwards)


@query("merged_references", f"with {td.EDGES_SQL} select from_assembly, upper(to_assembly) as to_fold, min(to_assembly) as to_assembly from (select * from edges union all select from_assembly, lower(to_assembly) from edges) u group by 1, 2")
def _(spark, sf_dir):
    e = td.assembly_edges(spark, sf_dir)
    return graph.merged_references(e, e.withColumn("to_assembly", F.lower("to_assembly")))


@query("federation_first_match", "select n.n_name as assembly_name, min(r.r_regionkey) as server_index from nation n join region r on n.n_regionkey >= r.r_regionkey group by n.n_name")
def _(spark, sf_dir):
    nation, region = td.read(spark, sf_dir, "nation"), td.read(spark, sf_dir, "region")
    servers = nation.select(F.lower("n_name").alias("assembly_name"), F.explode(F.sequence(F.lit(0), "n_regionkey")).alias("server_index")).join(region.select(F.col("r_regionkey").alias("server_index")), "server_index")
    return graph.first_federation(nation.select(F.col("n_name").alias("assembly_name")), servers)


@query(
    "type_forward_closure",
    """with recursive c(a, cur, depth) as (
  select n_nationkey, cast(floor(n_nationkey / 2) as int), 1 from nation where n_nationkey > 0
  union all select c.a, cast(floor(c.cur / 2) as int), c.depth + 1 from c where c.cur > 0)
select a as assembly, 't' as type_id, cur as terminal, depth from (select a, cur, depth, row_number() over (partition by a order by depth desc) as rn from c) t where rn = 1""",
)
def _(spark, sf_dir):
    n = td.read(spark, sf_dir, "nation").filter("n_nationkey > 0")
    return closure.forward_closure(n.select(F.col("n_nationkey").alias("assembly"), F.lit("t").alias("type_id"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("to_assembly")))


@query("type_forward_cycle", "select n_nationkey as assembly, 't' as type_id, n_nationkey // 5 * 5 + (n_nationkey + 4) % 5 as terminal, 4 as depth from nation")
def _(spark, sf_dir):
    """Nations forward in rings of five."""
    k = F.col("n_nationkey")
    return closure.forward_closure(td.read(spark, sf_dir, "nation").select(k.alias("assembly"), F.lit("t").alias("type_id"), (F.expr("n_nationkey div 5") * 5 + (k + 1) % 5).alias("to_assembly")))


@query(
    "folder_ancestors",
    """with recursive c(node, ancestor, distance) as (
  select n_nationkey, n_nationkey // 2, 1 from nation where n_nationkey > 0
  union all select c.node, c.ancestor // 2, c.distance + 1 from c where c.ancestor > 0)
select node, ancestor, distance from c""",
)
def _(spark, sf_dir):
    n = td.read(spark, sf_dir, "nation")
    return closure.ancestors(n.select(F.col("n_nationkey").alias("node"), F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 2).cast("int")).alias("parent")))


_MAPS = [(0, "https://site0.example/a", "s0/"), (1, "https://site1.example", "s1/"), (2, "https://site0.example", "s2/"), (3, "http:", "s3/")]


@query(
    "server_path_first_match",
    "with m(map_order, root, server) as (values " + ", ".join(map(str, _MAPS)) + """),
h as (select url as path, m.*, row_number() over (partition by page_id order by map_order) as rn from pages join m on url = root or starts_with(url, root || '/'))
select distinct path, server || substr(path, length(root) + 1) as url from h where rn = 1""",
)
def _(spark, sf_dir):
    maps = spark.createDataFrame(_MAPS, "map_order int, root string, server string")
    return graph.first_server_path(td.read(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct(), maps)


@query(
    "explorer_references",
    f"""with {td.EDGES_SQL}, n as (select n_name, n_nationkey as k from nation),
declared as (select a.n_name as from_assembly, b.n_name as to_assembly, b.k from n a join n b on a.k % 5 = b.k % 5 and a.k <> b.k union select from_assembly, to_assembly, k from edges join n on n_name = to_assembly where k % 3 = 0)
select from_assembly, to_assembly, exists (select 1 from edges e where e.from_assembly = d.from_assembly and e.to_assembly = d.to_assembly and d.k % 2 = 0) as used,
       case when k < 10 then 'link' when k < 20 then 'federated' else 'plain' end as shown from declared d""",
)
def _(spark, sf_dir):
    e = td.assembly_edges(spark, sf_dir)
    n = td.read(spark, sf_dir, "nation")
    numbered = n.select(F.col("n_name").alias("to_assembly"), F.col("n_nationkey").alias("k"))
    own = n.select(F.col("n_name").alias("from_assembly"), F.col("n_nationkey").alias("j")).join(numbered, (F.col("j") % 5 == F.col("k") % 5) & (F.col("j") != F.col("k")))
    third = e.join(numbered.filter("k % 3 = 0"), "to_assembly")
    declared = own.select("from_assembly", "to_assembly").unionByName(third.select("from_assembly", "to_assembly")).distinct()
    used = e.join(numbered.filter("k % 2 = 0"), "to_assembly", "left_semi")
    indexed = n.filter("n_nationkey < 10").select(F.col("n_name").alias("assembly"))
    servers = n.filter("n_nationkey < 20").select(F.col("n_name").alias("assembly_name"), F.lit(0).alias("server_index"))
    return graph.explorer_references(declared, used, indexed, servers)


@query("external_references", "select n_name as assembly, 'p' || n_nationkey as path from nation where n_nationkey >= 15")
def _(spark, sf_dir):
    n = td.read(spark, sf_dir, "nation")
    row = lambda off: n.select(F.col("n_name").alias("assembly"), F.concat(F.lit("p"), (F.col("n_nationkey") + off).cast("string")).alias("path"), (-F.lit(abs(off))).alias("seq"))
    part = lambda a, b: n.filter(F.col("n_nationkey").between(a, b)).select(F.col("n_name").alias("assembly"))
    return graph.collapse_external(row(0).unionByName(row(100)), part(0, 4), part(5, 9), part(10, 14))


@query("custom_order", "select *, row_number() over (order by coalesce(position, 2147483647), assembly) as rank from (select n_name as assembly, case when n_nationkey < 5 then 4 - n_nationkey end as position from nation) t")
def _(spark, sf_dir):
    n = td.read(spark, sf_dir, "nation")
    return graph.custom_order(n.select(F.col("n_name").alias("assembly")), n.filter("n_nationkey < 5").select(F.col("n_name").alias("assembly"), (4 - F.col("n_nationkey")).alias("position")))


# ---------------------------------------------------------------- statistics and choice


@query("source_stats", "select source, count(*) as docs, sum(n_chars) as chars, cast(sum(length(text) - length(replace(text, chr(10), '')) + 1) as bigint) as lines from documents group by source")
def _(spark, sf_dir):
    return stats.text_stats(td.read(spark, sf_dir, "documents"), "source", "text", "n_chars")


@query("aggregate_stats", "select count(*) as projects, sum(d) as docs, sum(c) as chars, format('{:,}', count(*)) as projects_text, format('{:,}', cast(sum(d) as bigint)) as docs_text, format('{:,}', cast(sum(c) as bigint)) as chars_text from (select source, count(*) as d, cast(sum(n_chars) as bigint) as c from documents group by source) t")
def _(spark, sf_dir):
    return stats.totals(stats.text_stats(td.read(spark, sf_dir, "documents"), "source", "text", "n_chars"), ["docs", "chars"])


@query(
    "project_stats",
    f"with {td.SYMBOLS_SQL} select assembly_name, count(*) as documents, cast(sum(length(name)) as bigint) as chars, count(*) as lines, count(*) as symbols, count(*) filter (where kind_rank = 1) as types, count(*) filter (where kind_rank = 1 and assembly_number % 2 = 0) as public_types from symbols group by assembly_name",
)
def _(spark, sf_dir):
    s = td.symbols(spark, sf_dir).withColumn("is_public", F.col("assembly_number") % 2 == 0)
    return stats.project_stats(s.select("assembly_name", F.lit(1).alias("lines"), F.length("name").alias("chars")), s, "assembly_name")


@query("usage_by_user", "select cast(user_id as varchar) as \"user\", count(*) as n from events group by 1")
def _(spark, sf_dir):
    return stats.usage(td.read(spark, sf_dir, "events"), F.col("user_id"))


@query("bigram_frequencies", "select pair, count(*) as n from (select unnest(list_transform(range(1, length(p_name)), lambda i: substr(p_name, i, 2))) as pair from part) t group by pair")
def _(spark, sf_dir):
    return stats.bigrams(td.read(spark, sf_dir, "part"), "p_name")


@query("unique_prefix_length", "with v as (select distinct p_name as v from part), k as (select k from range(1, 100) r(k)) select cast(min(k) as int) as k from (select k, count(distinct substr(v, 1, k)) as d, count(*) as n from v, k group by k) t where d = n")
def _(spark, sf_dir):
    return stats.unique_prefix_length(td.read(spark, sf_dir, "part"), "p_name")


@query("line_glyphs", "with e as (select user_id, event_id % 50 + 1 as line, event_type as glyph from events), s as (select user_id, unnest(range(1, max(line) + 1)) as line from e group by user_id) select s.user_id, s.line, coalesce(string_agg(distinct glyph, ',' order by glyph), '') as glyphs from s left join e on e.user_id = s.user_id and e.line = s.line group by 1, 2")
def _(spark, sf_dir):
    return stats.glyphs_by_line(td.read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50 + 1).alias("line"), F.col("event_type").alias("glyph")), "user_id")


@query("best_candidate", "select p_type, p_size, p_partkey, score from (select p_type, p_size, p_partkey, p_size * 1000 + p_partkey % 7 as score, row_number() over (partition by p_type, p_size order by p_size * 1000 + p_partkey % 7 desc, p_partkey) as rn from part) t where rn = 1")
def _(spark, sf_dir):
    scored = td.read(spark, sf_dir, "part").select("p_type", "p_size", "p_partkey", (F.col("p_size") * 1000 + F.col("p_partkey") % 7).alias("score"))
    return selection.best(scored, ["p_type", "p_size"], "score", "p_partkey")


@query("invocation_scores", "select p_partkey, cast(case when p_partkey % 97 = 0 then 2147483647 else case when p_partkey % 5 = 0 then -10000 else 0 end + (p_partkey % 9) * 1000 + (p_partkey % 3) * 100 + case p_partkey % 4 when 1 then 600 when 2 then 550 when 3 then 500 else 0 end + p_size end as int) as score from part")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    platform = F.element_at(F.array(*map(F.lit, ("", "-linux", "-unix", "-windows"))), (k % 4 + 1).cast("int"))
    framework = F.concat(F.lit("net"), (k % 9).cast("string"), F.lit("."), (k % 3).cast("string"), platform)
    properties = F.create_map(F.lit("TargetFramework"), framework, F.lit("IsPlatformNotSupportedAssembly"), F.when(k % 5 == 0, "True").otherwise("no"), F.lit("UseForSourceIndex"), F.when(k % 97 == 0, "true").otherwise(""))
    return td.read(spark, sf_dir, "part").select("p_partkey", selection.invocation_score(properties, F.col("p_size")).alias("score"))


@query("retention_newest_10", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) t where rn <= 10")
def _(spark, sf_dir):
    orders = td.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return selection.newest(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("set_difference", "select c_custkey as path from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'")
def _(spark, sf_dir):
    urgent = td.read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("path"))
    return selection.difference(td.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path")), urgent)


@query("dedupe_first_seen", "select p_name, p_partkey from (select p_name, p_partkey, row_number() over (partition by p_name order by p_partkey) as rn from part) t where rn = 1")
def _(spark, sf_dir):
    return selection.first_seen(td.read(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_name", "p_partkey")


@query("duplicate_names", "select p_brand, p_name, count(*) as n from part group by 1, 2 having count(*) > 1")
def _(spark, sf_dir):
    return selection.duplicates(td.read(spark, sf_dir, "part"), ["p_brand", "p_name"])


@query("stale_containers", "select s_suppkey as container, greatest(s_nationkey - 1, 0) as ttl, s_nationkey <= 1 as \"delete\" from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity >= 50 and l_linenumber = 1 and l_returnflag = 'R')")
def _(spark, sf_dir):
    used = td.read(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_linenumber = 1 and l_returnflag = 'R'").select(F.col("l_suppkey").alias("container"))
    return selection.containers(td.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("container"), F.col("s_nationkey").alias("ttl")), used)


@query("collision_suffix", "select p_partkey, p_name || case when rn > 1 then cast(rn as varchar) else '' end || '.cs' as file_name from (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as rn from part) t")
def _(spark, sf_dir):
    files = td.read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(".cs")).alias("f"))
    return numbering.collision_suffix(files, "f", [F.asc("p_partkey")]).select("p_partkey", "file_name")


@query("newest_archive", "select name from (select c_mktsegment || '/' || lpad(cast(c_custkey as varchar), 8, '0') as name from customer) t where starts_with(name, 'BUILDING/') order by name desc limit 1")
def _(spark, sf_dir):
    blobs = td.read(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit("/"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("name"))
    return selection.newest_archive(blobs, "BUILDING/")


# ---------------------------------------------------------------- trees


@query("namespace_tree", "with p as (select string_split(p_brand || '.' || p_type || '.' || p_name, '.') as parts from part), n as (select parts[1:k] as q from p, range(1, 4) r(k)) select array_to_string(q, '.') as path, case when len(q) > 1 then array_to_string(q[1:len(q) - 1], '.') end as parent, q[len(q)] as title, cast(len(q) as int) as depth, count(*) as leaves from n group by q")
def _(spark, sf_dir):
    names = td.read(spark, sf_dir, "part").select(F.concat_ws(".", "p_brand", "p_type", "p_name").alias("ns"))
    return hierarchy.namespace_tree(names, "ns")


@query("folder_tree", "with p as (select string_split(url, '/') as parts from pages), q as (select list_filter(parts[1:len(parts) - 1], lambda x: x <> '') as parts from p), n as (select parts[1:k] as q from (select parts, unnest(range(1, len(parts) + 1)) as k from q) t) select array_to_string(q, '/') as path, case when len(q) > 1 then array_to_string(q[1:len(q) - 1], '/') end as parent, q[len(q)] as title, cast(len(q) as int) as depth, count(*) as leaves from n group by q")
def _(spark, sf_dir):
    return hierarchy.folder_tree(td.read(spark, sf_dir, "pages"), "url")


@query("symbol_places", f"with {td.REFS_SQL} select to_symbol_id as symbol_id, count(distinct from_path) as files, count(*) as places from refs group by to_symbol_id")
def _(spark, sf_dir):
    places = td.references(spark, sf_dir).select(F.col("to_symbol_id").alias("symbol_id"), F.col("from_path").alias("file"), F.col("line").alias("offset"))
    return hierarchy.locations(places).select("symbol_id", "files", F.size("places").cast("long").alias("places"))


# ---------------------------------------------------------------- texts and spans


@query("line_stats", "select doc_id, cast(coalesce(len(l), 0) as int) as lines, cast(coalesce(list_max(l), 0) as int) as longest, cast(coalesce(list_sum(l), 0) as bigint) as chars from (select doc_id, case when text <> '' then list_transform(string_split(text, chr(10)), lambda x, i: length(x) + case when i < len(string_split(text, chr(10))) then 1 else 0 end) end as l from documents) t")
def _(spark, sf_dir):
    """Lines of every text; null and empty ones have none."""
    d = td.read(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.lf_line_lengths(F.col("text")), F.array().cast("array<int>")).alias("l"))
    return d.select("doc_id", F.size("l").alias("lines"), F.coalesce(F.array_max("l"), F.lit(0)).alias("longest"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"))


@query("line_starts", "with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents where doc_id is not null and text is not null) select doc_id, cast(line as int) as line, md5(t) as line_md5, cast(coalesce(sum(length(t) + 1) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) as bigint) as start from l")
def _(spark, sf_dir):
    rows = spans.line_starts(td.read(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", "line", F.md5(F.col("line_text").cast("binary")).alias("line_md5"), "start")


_WORD = f"([{spans.LETTERS}]+)"


@query("token_counts", f"select word, count(*) as n from (select unnest(regexp_extract_all(text, '{_WORD}', 1)) as word from documents) t group by word")
def _(spark, sf_dir):
    return spans.token_counts(td.read(spark, sf_dir, "documents"), "text")


@query("token_references", f"with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents) select word, doc_id, cast(line as int) as line, count(*) as n from (select doc_id, line, unnest(regexp_extract_all(t, '{_WORD}', 1)) as word from l) w group by 1, 2, 3")
def _(spark, sf_dir):
    return spans.token_references(td.read(spark, sf_dir, "documents"), "doc_id", "text")


_SPANS = "s as (select user_id, event_id * 10 as start, cast(event_id % 7 + 1 as bigint) as len, event_type from events)"


def _spans(spark, sf_dir):
    return td.read(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 10).alias("start"), (F.col("event_id") % 7 + 1).alias("len"), "event_type")


@query("span_fill_gaps", f"with {_SPANS}, g as (select *, coalesce(lag(start + len) over (partition by user_id order by start), 0) as before from s), t as (select user_id, max(start + len) as last from s group by user_id) select user_id, start, len, false as gap from s union all select user_id, before, start - before, true from g where start > before union all select user_id, last, 2000000 - last, true from t where last < 2000000")
def _(spark, sf_dir):
    return spans.fill_gaps(dealt(_spans(spark, sf_dir), "user_id").withColumn("total", F.lit(2000000).cast("long")).drop("event_type"), "user_id", "total")


@query("merge_islands", f"with {_SPANS}, m as (select *, event_type in ('click', 'view') as mg from s), b as (select *, case when mg and coalesce(lag(mg) over (partition by user_id order by start), false) then 0 else 1 end as b from m), i as (select *, sum(b) over (partition by user_id order by start) as island from b) select user_id, cast(island as bigint) as island, min(start) as start, max(start + len) - min(start) as len, count(*) as merged from i group by user_id, island")
def _(spark, sf_dir):
    return spans.merge_runs(dealt(_spans(spark, sf_dir), "user_id").withColumn("m", F.col("event_type").isin("click", "view")), "user_id", "m")


_OVERLAP = "s as (select user_id, event_id % 997 as start, event_id % 60 + 1 as len from events)"


@query("elementary_ranges", f"with {_OVERLAP}, e as (select distinct user_id, unnest([start, start + len]) as b from s), p as (select user_id, b as start, lead(b) over (partition by user_id order by b) as nxt from e) select user_id, start, nxt - start as len from p where nxt is not null and exists (select 1 from s where s.user_id = p.user_id and s.start <= p.start and s.start + s.len >= p.nxt)")
def _(spark, sf_dir):
    s = td.read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 997).alias("start"), (F.col("event_id") % 60 + 1).alias("len"))
    return spans.elementary(s, "user_id")


@query("span_drop_repeats", f"with {_OVERLAP}, d as (select *, lag(start) over (partition by user_id order by start, len) as a, lag(len) over (partition by user_id order by start, len) as b from s) select user_id, start, len from d where not coalesce(a = start and b = len, false)")
def _(spark, sf_dir):
    s = td.read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 997).alias("start"), (F.col("event_id") % 60 + 1).alias("len"))
    return spans.drop_repeats(s, "user_id")


@query("guid_literals", f"select {_GUID} as guid, count(*) as n from (select md5(cast(p_partkey % 100 as varchar)) as h from part) t group by 1")
def _(spark, sf_dir):
    h = F.md5((F.col("p_partkey") % 100).cast("string").cast("binary"))
    g = text.canonical_guid(h)
    forms = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('f(@"{'), F.upper(g), F.lit('}") + "x"'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('new("'), g, F.lit('")'))).otherwise(F.concat(F.lit('"'), h, F.lit('"')))
    return spans.guid_references(td.read(spark, sf_dir, "part").select("p_partkey", forms.alias("t")), "p_partkey", "t")


@query("semicolon_tokens", "select p_partkey, array_to_string(regexp_extract_all(replace(p_name, ' ', '; '), '(;|[ \\t\\r\\n]+|[^; \\t\\r\\n]+)', 1), '|') as tokens from part")
def _(spark, sf_dir):
    t = text.semicolon_tokens(F.replace("p_name", F.lit(" "), F.lit("; ")))
    return td.read(spark, sf_dir, "part").select("p_partkey", F.array_join(t, "|").alias("tokens"))


@query("html_escape", "select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) as escaped from pages")
def _(spark, sf_dir):
    return td.read(spark, sf_dir, "pages").select("page_id", F.md5(text.html_escape(F.col("html")).cast("binary")).alias("escaped"))


@query("page_links", "select page_id, u from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as u from pages) t")
def _(spark, sf_dir):
    return td.read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("u"))


@query("escape_fields", "select doc_id, md5(translate(text, ';' || chr(13) || chr(10), ':  ')) as escaped from documents")
def _(spark, sf_dir):
    return td.read(spark, sf_dir, "documents").select("doc_id", F.md5(text.escape_field(F.col("text")).cast("binary")).alias("escaped"))


@query("folded_names", f"select doc_id, md5({fold_sql('text')}) as folded from documents")
def _(spark, sf_dir):
    return td.read(spark, sf_dir, "documents").select("doc_id", F.md5(fold("text").cast("binary")).alias("folded"))


@query("description_namespace", f"with {td.SYMBOLS_SQL} select symbol_id, assembly_name || '.' || split_part(split_part(description, '(', 1), '.', 2) as namespace from symbols")
def _(spark, sf_dir):
    return td.symbols(spark, sf_dir).select("symbol_id", text.namespace_of(F.col("description")).alias("namespace"))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(
    "html_escape_offsets",
    f"""with s as (select page_id, trim(html, ' ') as t, cast(instr(html, '<title>') + 6 - (length(html) - length(ltrim(html, ' '))) as int) as a, cast(instr(html, '</body>') - 1 - (length(html) - length(ltrim(html, ' '))) as int) as b from pages where html is not null)
select page_id, md5({_ESC.format("t")}) as escaped, cast(case when a > 0 then length({_ESC.format("substr(t, 1, a)")}) else a end as int) as start, cast(case when b > 0 then length({_ESC.format("substr(t, 1, b)")}) else b end as int) as "end" from s""",
)
def _(spark, sf_dir):
    """Whole pages escaped, and a span of each, from its title to the end of its body, moved along."""
    a, b = F.instr("html", "<title>") + 6, F.instr("html", "</body>") - 1
    html, start, end = text.escape_span(F.col("html"), a, b)
    moved = td.read(spark, sf_dir, "pages").filter("html is not null").select("page_id", F.md5(html.cast("binary")).alias("escaped"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    return moved


@query("msbuild_split", "select p_partkey, '$(' || p_brand || '|$(' || p_type || ')|)|@(' || p_name || '-|>x)' as parts from part")
def _(spark, sf_dir):
    """Part descriptions with expressions in them, cut at these."""
    split = text.arrow(text.split_expressions, "array<string>")
    t = F.concat(F.lit("$("), "p_brand", F.lit("$("), "p_type", F.lit("))@("), "p_name", F.lit("->x)"))
    return td.read(spark, sf_dir, "part").select("p_partkey", F.array_join(split(t), "|").alias("parts"))


@query(
    "relative_path",
    r"""with p as (select page_id, translate(regexp_replace(url, '^[a-z]+://', ''), '/', '\') as t from pages)
select page_id, '..\' || t as far, '..\' || substr(t, instr(t, '\') + 1) as near from p""",
)
def _(spark, sf_dir):
    """Pages as seen from a folder of another site, and of their own."""
    rel = text.arrow(text.relative_to_file, "string")
    t = F.translate(F.regexp_replace("url", "^[a-z]+://", ""), "/", "\\")
    p = F.concat(F.lit("c:\\"), t)
    near = F.concat(F.lit("c:\\"), F.substring_index(t, "\\", 1), F.lit("\\index\\a.html"))
    return td.read(spark, sf_dir, "pages").select("page_id", rel(p, F.lit("c:\\other.site\\index.html")).alias("far"), rel(p, near).alias("near"))


# ---------------------------------------------------------------- build events


@query("event_pairing", "select user_id as key, event_id as seq, prev_id as start_seq from (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as pt, lag(event_id) over (partition by user_id order by ts, event_id) as prev_id from events where event_type in ('signup', 'click')) t where event_type = 'click' and pt = 'signup'")
def _(spark, sf_dir):
    return builds.pair_events(td.build_events(spark, sf_dir))


@query("property_overlay", "select user_id as key, event_type, max_by(json_extract_string(props, '$.k'), event_id) as value from events group by 1, 2")
def _(spark, sf_dir):
    changes = td.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_type", F.get_json_object("props", "$.k").alias("value"), F.col("event_id").alias("seq"))
    return builds.property_overlay(changes, ["key", "event_type"], order=("seq",))


@query("event_windows", "select time_bucket(interval '5 minutes', ts) as start, event_type, count(*) as n from events group by 1, 2")
def _(spark, sf_dir):
    counted = builds.windowed_counts(td.read(spark, sf_dir, "events").select("ts", "event_type"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


from . import catalogs  # noqa: E402, F401
