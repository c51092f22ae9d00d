"""The search language over texts made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.folding import fold_sql
from ..functions.kinds import KINDS
from ..operators import search
from ..plans import options, search as plan
from ..registered import query
from ..sources import testdata as td


def _strings(function):
    """A function of a text to a list of texts, as one of columns."""
    return text.arrow(function, "array<string>")


_TEXT = "p_name || '  \"' || p_brand || ' x\" ' || case p_partkey % 4 when 0 then 'type' when 1 then 'a.' || p_name when 2 then 'src\\' || p_brand else '\"open ' || p_size end"


def _text():
    k = F.col("p_partkey") % 4
    last = F.when(k == 0, "type").when(k == 1, F.concat(F.lit("a."), "p_name")).when(k == 2, F.concat(F.lit("src\\"), "p_brand")).otherwise(F.concat(F.lit('"open '), F.col("p_size").cast("string")))
    return F.concat("p_name", F.lit('  "'), "p_brand", F.lit(' x" '), last)


@query("query_tokens", f"""select p_partkey, array_to_string(regexp_extract_all({_TEXT}, '"[^"]*"?|[^ "]+'), '|') as tokens from part""")
def _(spark, sf_dir):
    return td.read(spark, sf_dir, "part").select("p_partkey", F.array_join(_strings(plan.tokenize)(_text()), "|").alias("tokens"))


_CLASSES = ", ".join(f"'{k}'" for k in KINDS)


@query(
    "query_terms",
    f"""with t as (select p_partkey, regexp_extract_all({_TEXT}, '"[^"]*"?|[^ "]+') as l from part),
c as (select *, list_filter(l, lambda x: x in ({_CLASSES})) as kinds, list_filter(l, lambda x: x not in ({_CLASSES}) and contains(x, '\\')) as paths,
             list_filter(l, lambda x: x not in ({_CLASSES}) and not contains(x, '\\') and contains(x, '.')) as dotted,
             list_distinct(list_filter(l, lambda x: x not in ({_CLASSES}) and not contains(x, '\\') and not contains(x, '.'))) as names from t)
select p_partkey, len(kinds) as kinds, len(paths) as paths, len(dotted) as dotted, len(names) as names, len(list_filter(names, lambda x: length(x) >= 3)) + len(dotted) as interpretations from c""",
)
def _(spark, sf_dir):
    """How many terms of each sort a text has, and how many readings come of them."""

    def sizes(t: str) -> list[str]:
        q = plan.parse(t)
        return [str(len(x)) for x in (q.kinds, q.paths, q.dotted, q.names, q.interpretations)]

    names = ("kinds", "paths", "dotted", "names", "interpretations")
    rows = td.read(spark, sf_dir, "part").select("p_partkey", _strings(sizes)(_text()).alias("n"))
    return rows.select("p_partkey", *(F.col("n")[k].cast("long").alias(x) for k, x in enumerate(names)))


@query(
    "query_readings",
    """with t as (select p_partkey, case p_partkey % 4 when 0 then 'get_' || split_part(p_name, ' ', 1) when 1 then 'A.set_' || split_part(p_name, ' ', 2) || '9' when 2 then split_part(p_name, ' ', 1) || '.Prop' else '"' || p_name || '"' end as q, p_name as n from part)
select p_partkey, case p_partkey % 4 when 0 then q || '/-|' || split_part(n, ' ', 1) || '/-' when 1 then 'set_' || split_part(n, ' ', 2) || '9/' || q || '|' || split_part(n, ' ', 2) || '9/A.' || split_part(n, ' ', 2) || '9'
       when 2 then q || '/-' else n || '/!' end as readings from t""",
)
def _(spark, sf_dir):
    """Readings of accessors, of dotted terms, of file names and of quoted terms: term and namespace, or ``!`` for a whole name."""
    k, first, second = F.col("p_partkey") % 4, F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    q = F.when(k == 0, F.concat(F.lit("get_"), first)).when(k == 1, F.concat(F.lit("A.set_"), second, F.lit("9"))).when(k == 2, F.concat(first, F.lit(".Prop"))).otherwise(F.concat(F.lit('"'), "p_name", F.lit('"')))
    read = _strings(lambda t: [f"{i.term}/{'!' if i.verbatim else i.namespace or '-'}" for i in plan.parse(t).interpretations])
    return td.read(spark, sf_dir, "part").select("p_partkey", F.array_join(read(q), "|").alias("readings"))


@query("query_notes", "select page_id, case when length(u) < 3 then 'Enter at least 3 characters.' when length(u) > 260 then 'The query is too long.' else '' end as note from (select page_id, case page_id % 3 when 0 then substr(url, 1, 2) when 1 then url else repeat(url, 10) end as u from pages) t")
def _(spark, sf_dir):
    k = F.col("page_id") % 3
    t = F.when(k == 0, F.substring("url", 1, 2)).when(k == 1, F.col("url")).otherwise(F.repeat("url", F.lit(10)))
    note = text.arrow(lambda x: plan.parse(x).note or "", "string")
    return td.read(spark, sf_dir, "pages").select("page_id", note(t).alias("note"))


@query("query_routes", "select p_partkey, case p_partkey % 6 when 0 then 'assemblies' when 1 then 'properties' when 2 then 'items' when 3 then 'targets' when 4 then 'tasks' else 'symbols,assemblies,projects,guids,properties,items,targets,tasks' end as routes from part")
def _(spark, sf_dir):
    words = F.array(*map(F.lit, ("assembly", "MSBuildProperty", "MSBuildItem", "MSBuildTarget", "MSBuildTask", "class")))
    t = F.concat_ws(" ", "p_name", F.element_at(words, (F.col("p_partkey") % 6 + 1).cast("int")))
    return td.read(spark, sf_dir, "part").select("p_partkey", F.array_join(_strings(lambda x: plan.route(plan.parse(x)))(t), ",").alias("routes"))


@query(
    "deep_links",
    "select p_partkey, case p_partkey % 4 when 0 then 'query|' || p_name when 1 then 'list|MSBuildItem|' || p_name when 2 then 'file|' || p_brand || '/a.cs|line=' || p_size else 'file|' || p_brand || '/a.cs|id=' || substr(md5(p_name), 1, 16) || '|pane=references' end as link from part",
)
def _(spark, sf_dir):
    def show(t: str) -> str:
        d = plan.deep_link(t)
        return "|".join([d["kind"], *d["args"]] if "args" in d else ["file", d["path"], *(f"{k}={d[k]}" for k in ("line", "id", "pane") if k in d)])

    k, file = F.col("p_partkey") % 4, F.concat("p_brand", F.lit("/a.cs,"))
    with_id = F.concat(file, F.substring(F.md5(F.col("p_name").cast("binary")), 1, 16), F.lit(",references"))
    t = F.when(k == 0, F.concat(F.lit("q="), "p_name")).when(k == 1, F.concat(F.lit("MSBuildItem="), "p_name")).when(k == 2, F.concat(file, F.col("p_size").cast("string"))).otherwise(with_id)
    return td.read(spark, sf_dir, "part").select("p_partkey", text.arrow(show, "string")(t).alias("link"))


@query(
    "command_options",
    """select p_partkey, 'c:\\o ' || p_brand || '|' || p_name || '|' || case when p_partkey % 2 = 0 then '/force' else '' end || '|c:\\a\\' || p_brand || '.csproj|' || case when p_size % 3 = 0 then 1 else 0 end || '|' || p_brand as options from part""",
)
def _(spark, sf_dir):
    """Command lines: output, a property, a flag, inputs of which some are of no known kind, and a server path."""

    def show(line: str) -> str:
        o = options.parse(line.split("|"))
        return "|".join([o.out, o.properties["Name"], ",".join(sorted(o.flags)), ",".join(o.projects), str(len(o.rejected)), o.server_paths["c:\\r"]])

    parts = [
        F.concat(F.lit('/out:"c:\\o '), "p_brand", F.lit('"')), F.concat(F.lit("/p:Name="), "p_name"), F.when(F.col("p_partkey") % 2 == 0, "/force"),
        F.concat(F.lit("c:\\a\\"), "p_brand", F.lit(".csproj")), F.when(F.col("p_size") % 3 == 0, "c:\\a\\readme.txt"), F.concat(F.lit('/serverPath:"c:\\r"='), "p_brand"),
    ]
    return td.read(spark, sf_dir, "part").select("p_partkey", text.arrow(show, "string")(F.concat_ws("|", *parts)).alias("options"))


def _branch(where: str, term: str) -> str:
    level = f"case when name = '{term}' then 1 when name_fold = {fold_sql(f"'{term}'")} then 2 when starts_with(name, '{term}') then 3 else 4 end"
    return f"(select *, {level} as match_level from (select * from symbols where {where} order by name_fold, kind_rank, name, assembly_number, symbol_id limit 100) x)"


@query(
    "search_ranked",
    f"with {td.SYMBOLS_SQL} select name, kind, assembly_name, symbol_id, row_number() over (order by match_level, kind_rank, name, assembly_number, description, symbol_id) as rank from {_branch("starts_with(name_fold, 'RED')", 'red')} b",
)
def _(spark, sf_dir):
    """The order of relevance itself."""
    return search.ranked(search.search_symbols(td.symbols(spark, sf_dir), "red")).select("name", "kind", "assembly_name", "symbol_id", "rank")


@query(
    "result_page",
    f"""with {td.SYMBOLS_SQL}, {td.ASSEMBLIES_SQL},
s as (select 'symbols' as section, name as title, count(*) as n from (select * from symbols where starts_with(name_fold, 'BRAND#1') order by name_fold, kind_rank, name, assembly_number, symbol_id limit 100) x group by 2),
a as (select 'assemblies', assembly_name, 1 from keyed where project_key <> -1 and starts_with(upper(assembly_name), 'BRAND#1')),
p as (select 'properties', name, 1 from (select distinct p_brand || ' ' || p_type as name from part where starts_with(p_brand, 'Brand#1')) t order by {fold_sql("name")}, name limit 100),
u as (select * from s union all select * from a union all select * from p),
c as (select section, cast(sum(n) as bigint) as shown from u group by 1)
select u.section, u.title, cast(u.n as bigint) as n, case when shown = 100 then 'showing first 100' else cast(shown as varchar) end as header from u join c using (section)""",
)
def _(spark, sf_dir):
    """All groups of a result page that have rows."""
    k = td.keyed(spark, sf_dir)
    names = td.read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("name"))
    index = search.Index(td.symbols(spark, sf_dir), k, k.filter("project_key <> -1").select("project_key", "project_path"), {"properties": names})
    return index.page("brand#1")


@query("result_headers", "select p_partkey, case when k >= 100 then 'Displaying top 100 results out of ' || greatest(k, p) || ':' when k = 0 then 'No results found.' else k || ' result' || case when k = 1 then '' else 's' end || ' found:' end as header from (select p_partkey, p_partkey % 102 as k, p_size * 10 as p from part) t")
def _(spark, sf_dir):
    head = text.arrow(lambda a, b: search.result_count(int(a), int(b)), "string")
    return td.read(spark, sf_dir, "part").select("p_partkey", head(F.col("p_partkey") % 102, F.col("p_size") * 10).alias("header"))
