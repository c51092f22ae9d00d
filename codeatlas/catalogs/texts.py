"""Scalar rules, each over a column made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.plugins import Registry
from ..operators import extract, lexing, msbuild, references as refs_, selection, spans
from ..registered import query
from ..runtime import dealt
from ..sources import testdata as td


def _pick(k, *values):
    """The value of the remainder ``k``."""
    return F.coalesce(*(F.when(k == j, v) for j, v in enumerate(values)))


def _part(spark, sf_dir):
    return td.read(spark, sf_dir, "part")


@query("url_encoded", "select p_partkey, replace(replace(p_name || ' ' || p_brand, ' ', '+'), '#', '%23') || '%u00e9%7b' as encoded from part")
def _(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", text.arrow(text.url_encode, "string")(F.concat("p_name", F.lit(" "), "p_brand", F.lit("é{"))).alias("encoded"))


@query("stripped_quotes", "select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then p_name when 2 then p_name else '\"' || p_name end as bare from part")
def _(spark, sf_dir):
    n, q = F.col("p_name"), F.lit('"')
    quoted = _pick(F.col("p_partkey") % 4, F.concat(q, n, q), F.concat(F.lit("'"), n, F.lit("'")), F.concat(q, F.lit("'"), n, F.lit("'"), q), F.concat(q, n))
    return _part(spark, sf_dir).select("p_partkey", text.strip_quotes(quoted).alias("bare"))


@query("sanitized_paths", "select page_id, regexp_replace(url, '[\"<>|:*?\\\\/]', '_', 'g') as file, case page_id % 4 when 0 then 'current' when 1 then 'parent' when 2 then 'c' else replace(url, '|', '_') end as folder, repeat('../', cast(length(url) - length(replace(url, '/', '')) as int)) as up, replace(replace(url, ':', ''), ' ', '') as page from pages")
def _(spark, sf_dir):
    u = F.col("url")
    folder = _pick(F.col("page_id") % 4, F.lit("."), F.lit(".."), F.lit("c::"), u)
    return td.read(spark, sf_dir, "pages").select("page_id", text.sanitize_file(u).alias("file"), text.sanitize_folder(folder).alias("folder"), text.depth_to_root(u).alias("up"), text.page_path(u).alias("page"))


@query("paths_in_cone", r"select p_partkey, case p_partkey % 4 when 0 then 'c:\src\p\' || p_name when 1 then 'c:\src\p\' || p_name when 2 then 'c:\src\p\other\' || p_name else 'c:\src\p\d\x\' || p_name end as path from part")
def _(spark, sf_dir):
    """Files of a project, one without a root, one beside it, and one of another drive, as if all were in it."""
    n = F.col("p_name")
    p = _pick(F.col("p_partkey") % 4, F.concat(F.lit("C:\\src\\p\\"), n), n, F.concat(F.lit("c:\\src\\other\\"), n), F.concat(F.lit("d:\\x\\"), n))
    placed = text.arrow(lambda path: text.in_cone("c:\\src\\p", path), "string")(p)
    return _part(spark, sf_dir).select("p_partkey", F.regexp_replace(placed, "^C:", "c:").alias("path"))


@query("command_lines", "select p_partkey, '/out:' || p_name || ' ' || p_brand as arguments from part")
def _(spark, sf_dir):
    rest = F.concat(F.lit("/out:"), "p_name", F.lit(" "), "p_brand")
    start = _pick(F.col("p_partkey") % 3, F.lit('"C:\\x y\\csc.exe" '), F.lit("/opt/tools/run --quiet /sdk/vbc.dll "), F.lit("csc "))
    return _part(spark, sf_dir).select("p_partkey", text.trim_compiler(F.concat(start, rest)).alias("arguments"))


@query("excluded_projects", "select page_id, string_split(url, '/')[-2] in ('fr', 'de') or string_split(url, '/')[-3] = 'm.ththth.example.net' as excluded from pages")
def _(spark, sf_dir):
    """Folders of the pages, of which two languages and one host stand for what an index leaves out."""
    folder = F.regexp_replace("url", "/[^/]*$", "")
    found = selection.excluded(folder, ("fr", "de"), ("m.ththth.example.net",))
    return td.read(spark, sf_dir, "pages").select("page_id", found.alias("excluded"))


@query("test_projects", f"with {td.EDGES_SQL} select from_assembly, bool_or(regexp_matches(lower(to_assembly), 'nation_1$|nation_7')) as is_test from edges group by 1")
def _(spark, sf_dir):
    """Assemblies by whether any that they refer to is one of two that stand for test frameworks."""
    used = td.assembly_edges(spark, sf_dir).groupBy("from_assembly").agg(F.collect_set("to_assembly").alias("used"))
    return used.select("from_assembly", selection.is_test_project(F.col("used"), "nation_1$|nation_7").alias("is_test"))


@query("server_options", "select p_partkey, case p_partkey % 5 when 4 then null else p_name end as key, case p_partkey % 5 when 4 then null else p_brand end as value from part")
def _(spark, sf_dir):
    n, b, q = F.col("p_name"), F.col("p_brand"), F.lit('"')
    forms = _pick(F.col("p_partkey") % 5, F.concat(q, n, F.lit('"="'), b, q), F.concat(q, n, F.lit('"='), b), F.concat(n, F.lit('="'), b, q), F.concat(q, n, F.lit("="), b, q), n)
    return _part(spark, sf_dir).select("p_partkey", text.server_option(forms).alias("f")).select("p_partkey", "f.key", "f.value")


@query("external_links", "select p_partkey, case p_partkey % 3 when 2 then p_brand || '/A.html#x' else 'https://s' || (p_partkey % 3) || '.example/' || p_brand || '/A.html#' || substr(md5('T:' || p_partkey), 1, 16) end as url from part")
def _(spark, sf_dir):
    k = F.col("p_partkey") % 3
    token = text.external_link(k, F.col("p_brand"), ids.symbol_id(F.concat(F.lit("T:"), F.col("p_partkey").cast("string"))))
    link = F.when(k == 2, F.concat("p_brand", F.lit("/A.html#x"))).otherwise(token)
    return _part(spark, sf_dir).select("p_partkey", text.resolve_link(link, ["https://s0.example/", "https://s1.example/"]).alias("url"))


@query("empty_arrays", "with w as (select *, split_part(p_name, ' ', 1) as w from part) select p_partkey, concat_ws('|', case when p_size % 4 = 0 then 'new ' || w || '[0]' end, case when p_size % 3 = 0 then 'new ' || w || '[] {}' end) as found from w")
def _(spark, sf_dir):
    """Code with an array of as many elements as the part's size says, and one with a list that may be empty."""
    w, size = F.substring_index("p_name", " ", 1), F.col("p_size")
    code = F.concat(F.lit("a = new "), w, F.lit("["), (size % 4).cast("string"), F.lit("]; b = new "), w, F.lit("[] {"), F.when(size % 3 == 0, "").otherwise(F.col("p_type")), F.lit("};"))
    return _part(spark, sf_dir).select("p_partkey", F.array_join(text.empty_array_allocations(code), "|").alias("found"))


@query("property_names", "select p_partkey, case p_partkey % 3 when 2 then null else p_name end as name from part")
def _(spark, sf_dir):
    n = F.col("p_name")
    return _part(spark, sf_dir).select("p_partkey", text.property_name(_pick(F.col("p_partkey") % 3, n, F.concat(n, F.lit(".Length")), F.concat(F.lit("$("), n))).alias("name"))


@query("well_declared", "select good, count(*) as n from (select distinct word, length(word) > 2 and not regexp_matches(word, '[;\\r\\n]') as good from (select unnest(string_split(text, ' ')) as word from documents) t) u group by good")
def _(spark, sf_dir):
    """All words of the documents, by whether they could be declared names."""
    words = td.read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.groupBy(text.declares_well(F.col("word")).alias("good")).agg(F.count(F.lit(1)).alias("n"))


@query("assembly_names", "select p_partkey, case p_partkey % 6 when 0 then p_type when 1 then 'Root.' || p_type when 2 then 'p' || p_partkey || '.x' when 3 then 'M-' || p_type when 4 then 'a b ' || p_type else 'p' || p_partkey || '.x' end as name from part")
def _(spark, sf_dir):
    """Each step of the cascade: the name, the root namespace, the file, a module's name, an element that is no plain name, a binary."""
    t, k = F.col("p_type"), F.col("p_partkey") % 6
    element = lambda x: F.concat(F.lit("<Project><AssemblyName>"), x, F.lit("</AssemblyName>"))
    root = F.concat(element(F.lit("$(RootNamespace)")), F.lit("<RootNamespace>Root."), t, F.lit("</RootNamespace>"))
    module = F.concat(F.lit("<ModuleAssemblyName>M-"), t, F.lit("</ModuleAssemblyName>"))
    project = _pick(k, element(t), root, F.lit("<Project/>"), module, element(F.concat(F.lit("a b "), t)), element(t))
    path = F.concat(F.lit("c:\\a\\p"), F.col("p_partkey").cast("string"), F.lit(".x"), F.when(k == 5, ".DLL").otherwise(".csproj"))
    return _part(spark, sf_dir).select("p_partkey", text.assembly_name(project, path).alias("name"))


@query("descriptions", "select p_partkey, case when p_partkey % 4 < 3 then p_brand || '.' else '' end || p_name || case when p_size % 2 = 0 then '<T, U>' else '' end || case p_partkey % 3 when 0 then '' when 1 then '()' else '(int, ' || p_type || ')' end as description from part")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    container = F.when(k % 4 < 3, F.col("p_brand")).otherwise("")
    generic = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("T"), F.lit("U"))).otherwise(F.array().cast("array<string>"))
    parameters = F.when(k % 3 == 1, F.array().cast("array<string>")).when(k % 3 == 2, F.array(F.lit("int"), F.col("p_type")))
    return _part(spark, sf_dir).select("p_partkey", text.describe(container, F.col("p_name"), parameters, generic).alias("description"))


@query("hex_bytes", "select p_partkey, lower(hex(encode(p_name))) as hexed, p_name as back from part")
def _(spark, sf_dir):
    h = F.lower(F.hex(F.col("p_name").cast("binary")))
    return _part(spark, sf_dir).select("p_partkey", h.alias("hexed"), F.unhex(h).cast("string").alias("back"))


@query("varints", "select p_partkey, p_partkey * 12345 as back, cast(case when p_partkey * 12345 < 128 then 1 when p_partkey * 12345 < 16384 then 2 when p_partkey * 12345 < 2097152 then 3 when p_partkey * 12345 < 268435456 then 4 else 5 end as int) as bytes from part")
def _(spark, sf_dir):
    def both(n: int) -> list[int]:
        data = ids.varint_encode(int(n))
        return [ids.varint_decode(data)[0], len(data)]

    v = text.arrow(both, "array<long>")(F.col("p_partkey") * 12345)
    return _part(spark, sf_dir).select("p_partkey", v.alias("v")).select("p_partkey", F.col("v")[0].alias("back"), F.col("v")[1].cast("int").alias("bytes"))


@query("any_line_lengths", "select p_partkey, cast(length(p_name) + 2 as int) as first, cast(length(p_brand) + 1 as int) as second, cast(length(p_type) + 1 as int) as third, 4 as n, 2 as line from part")
def _(spark, sf_dir):
    """Lines that end with each kind of break, and the line of a position in the third."""

    t = F.concat("p_name", F.lit("\r\n"), "p_brand", F.lit("\r"), "p_type", F.lit("\nend"))
    m = _part(spark, sf_dir).select("p_partkey", text.any_line_lengths(t).alias("m"))
    lengths = F.col("m")
    third = text.line_at(lengths, lengths[0] + lengths[1])
    return m.select("p_partkey", *(lengths[k].alias(x) for k, x in enumerate(("first", "second", "third"))), F.size(lengths).alias("n"), third.alias("line"))


# ---------------------------------------------------------------- extraction


_TARGETS_SQL = f"{td.REFS_SQL}, {td.SYMBOLS_SQL}, t as (select r.*, s.kind as target_kind from refs r join symbols s on s.symbol_id = r.to_symbol_id)"


def _targets(spark, sf_dir):
    """References with the kind of the symbol that they refer to."""
    kinds = td.symbols(spark, sf_dir).select(F.col("symbol_id").alias("to_symbol_id"), F.col("kind").alias("target_kind"))
    return dealt(td.references(spark, sf_dir), "to_symbol_id").join(kinds, "to_symbol_id")


def _counted(rows, *by):
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


@query("token_styles", f"with {_TARGETS_SQL} select target_kind, case when target_kind in ('class', 'struct', 'interface') then 't' when target_kind in ('method', 'property', 'field') then 'i' else 'unknownClassification' end as style, count(*) as n from t group by 1, 2")
def _(spark, sf_dir):
    """Styles of the tokens that refer to symbols, whose class is named for the symbol's kind."""
    t = _targets(spark, sf_dir)
    return _counted(t, "target_kind", extract.style(F.concat("target_kind", F.lit(" name"))).alias("style"))


@query("script_marks", f"with {_TARGETS_SQL} select case target_kind when 'class' then 0 when 'interface' then 48 when 'method' then 72 when 'property' then 102 else 195 end as glyph, case when target_kind in ('class', 'interface') then 't' end as style, count(*) as n from t group by 1, 2")
def _(spark, sf_dir):
    """The same tokens as declarations and classes of a script."""
    kind = F.col("target_kind")
    return _counted(_targets(spark, sf_dir), extract.script_glyph(kind).alias("glyph"), extract.script_style(F.concat(kind, F.lit(" name"))).alias("style"))


_BARE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


def _shown(spans, doc: str):
    """Pages of the spans, without the marks around them, which must be the whole text."""
    page = extract.document_html(spans.select(doc, "start", F.col("token").alias("text"), "style", F.lit(None).cast("string").alias("href")), doc)
    bare = F.regexp_replace("html", "</?span[^>]*>", "")
    return page.select(doc, F.md5(bare.cast("binary")).alias("html_md5"), (F.length("html") > F.length(bare)).alias("marked"))


@query("markup_pages", f"select page_id, md5({_BARE.format('html')}) as html_md5, true as marked from pages where html is not null and html <> ''")
def _(spark, sf_dir):
    """Pages as documents of classified spans, which cover each page once."""
    return _shown(lexing.markup_spans(td.read(spark, sf_dir, "pages"), "page_id", "html"), "page_id")


@query("markup_classes", "with a as (select unnest(regexp_extract_all(html, '<!--.*?-->')) as c from pages) select 'comment' as class, count(*) as n, cast(sum(length(c)) as bigint) as chars from a")
def _(spark, sf_dir):
    """Comments of all pages by the lexer."""
    spans = lexing.markup_spans(td.read(spark, sf_dir, "pages"), "page_id", "html").filter(F.col("class") == "comment")
    return spans.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("chars"))


#: The first script of a page, whose text may hold end tags of other elements.
_SCRIPT = "(?s)<script>(.*?)</script>"


def _scripts(spark, sf_dir):
    return td.read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", _SCRIPT, 1).alias("script"))


@query("script_pages", f"select page_id, md5({_BARE.format('s')}) as html_md5, true as marked from (select page_id, regexp_extract(html, '{_SCRIPT}', 1) as s from pages) t where s <> ''")
def _(spark, sf_dir):
    """The scripts of pages as documents of classified spans."""
    return _shown(lexing.script_spans(_scripts(spark, sf_dir), "page_id", "script"), "page_id")


@query("script_words", f"with w as (select unnest(regexp_extract_all(regexp_replace(regexp_extract(html, '{_SCRIPT}', 1), '\"[^\"]*\"', '', 'g'), '[A-Za-z_$][A-Za-z_$0-9]*')) as token from pages) select token, count(*) as n from w group by 1")
def _(spark, sf_dir):
    """Words of the pages' scripts outside of strings."""
    words = lexing.script_spans(_scripts(spark, sf_dir), "page_id", "script").filter(F.col("class").isin("keyword", "identifier"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "reference_kinds",
    f"""with {_TARGETS_SQL}, d as (select seq // 100 as o, min(target_kind) as derived from t where line = 1 group by 1)
select target_kind, derived, case when target_kind in ('field', 'property') and col_start % 2 = 0 then 6 when line = 2 and target_kind = 'class' then 0
  when line = 2 and target_kind = 'interface' and derived = 'interface' then 1 when line = 2 and target_kind = 'interface' then 2 else 8 end as kind, count(*) as n
from t join d on t.seq // 100 = d.o group by 1, 2, 3""",
)
def _(spark, sf_dir):
    """An order's first line as a type, the second as what stands in its base list, and even columns as writes."""
    t = _targets(spark, sf_dir).withColumn("o", F.floor(F.col("seq") / 100))
    types = t.filter("line = 1").groupBy("o").agg(F.min("target_kind").alias("derived"))
    kind = extract.reference_kind(F.col("line") == 2, F.col("target_kind"), F.col("derived"), F.lit(True), F.col("target_kind"), F.col("col_start") % 2 == 0)
    return _counted(t.join(types, "o"), "target_kind", "derived", kind.alias("kind"))


@query("named_references", "select p_partkey, case when p_partkey % 4 = 2 then p_type || ' .ctor' when p_partkey % 4 = 1 then 'this' else p_name end as to_name from part where p_partkey % 4 <> 0")
def _(spark, sf_dir):
    k = F.col("p_partkey") % 4
    rows = _part(spark, sf_dir).select("p_partkey", _pick(k, F.lit("base"), F.lit("this"), F.lit(".ctor"), F.col("p_name")).alias("to_name"), F.when(k == 0, "type").otherwise("method").alias("to_kind"), F.col("p_type").alias("to_type"))
    return extract.named_references(rows).select("p_partkey", "to_name")


@query("eligible_symbols", f"with {_TARGETS_SQL}, u as (select to_symbol_id, min(target_kind) as k, count(distinct from_assembly) as users, count(distinct kind) as kinds from t group by 1) select to_symbol_id, users >= 14 and not (k = 'method' and kinds = {td.REFERENCE_KINDS}) as eligible from u")
def _(spark, sf_dir):
    """Symbols that few assemblies use are taken for locals, and methods that are used in every way for constructors."""
    # Sets have as many members as there are assemblies and kinds; counting distinct ones would double the rows.
    used = _targets(spark, sf_dir).groupBy("to_symbol_id").agg(F.min("target_kind").alias("k"), F.size(F.collect_set("from_assembly")).alias("users"), F.size(F.collect_set("kind")).alias("kinds"))
    kind = F.when(F.col("users") < 14, "local").otherwise(F.col("k"))
    name = F.when((F.col("k") == "method") & (F.col("kinds") == td.REFERENCE_KINDS), ".ctor").otherwise(F.col("to_symbol_id"))
    return used.select("to_symbol_id", extract.eligible(kind, name).alias("eligible"))


@query(
    "token_links",
    f"""with {_TARGETS_SQL} select case when line = 1 and from_assembly = to_assembly then 'partial' when line = 1 then 'declaration' when starts_with(to_symbol_id, 'f') then 'guid'
  when target_kind = 'field' and col_start % 5 = 0 then 'empty_array' when to_name is not null and n_nationkey < 12 then 'reference' when to_name is not null and n_nationkey < 20 then 'federated' end as link, count(*) as n
from t join nation on n_name = to_assembly group by 1""",
)
def _(spark, sf_dir):
    """Tokens of the references: assemblies up to one number are here, those up to another on some other server."""
    nations = td.read(spark, sf_dir, "nation").select(F.col("n_name").alias("to_assembly"), "n_nationkey")
    t = _targets(spark, sf_dir).join(nations, "to_assembly")
    first, key = F.col("line") == 1, F.col("n_nationkey")
    guid = F.when(F.col("to_symbol_id").startswith("f"), F.col("to_symbol_id"))
    empty = (F.col("target_kind") == "field") & (F.col("col_start") % 5 == 0)
    made = extract.link(first, F.col("from_assembly") == F.col("to_assembly"), F.col("to_name"), key < 12, F.when(key < 20, key), guid, empty)
    return _counted(t, made.alias("link"))


@query("reference_urls", "select p_partkey, case when p_partkey % 2 = 0 then '../p.html#' || p_size else '../../' || p_brand || '/p.html#' || p_size end as url from part")
def _(spark, sf_dir):
    to = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.lit("other"))
    return _part(spark, sf_dir).select("p_partkey", extract.reference_url(F.col("p_brand"), to, F.lit("p.html"), F.col("p_size")).alias("url"))


#: Build files with lines of their own; each tenth breaks off after its target's tag.
_BUILD = """f as (select p_partkey as path, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b, p_brand as c, length(split_part(p_name, ' ', 1)) as na, length(split_part(p_name, ' ', 2)) as nb, length(p_brand) as nc, p_partkey % 10 = 0 as cut from part),
 r as (
  select path, 'MSBuildPropertyAssignment' as kind, a || 'DependsOn' as name, 'MSBuildProperties' as to_assembly, 3 as line, 5 as col_start, na + 9 as n from f
  union all select path, 'MSBuildPropertyUsage', b, 'MSBuildProperties', 3, na + 17, nb from f
  union all select path, 'MSBuildTargetUsage', c, 'MSBuildTargets', 3, na + nb + 26, nc from f
  union all select path, 'MSBuildTargetUsage', 'x', 'MSBuildTargets', 3, na + nb + nc + 28, 1 from f
  union all select path, 'MSBuildItemAssignment', b, 'MSBuildItems', 6, 5, nb from f
  union all select path, 'MSBuildItemUsage', a, 'MSBuildItems', 6, nb + 17, na from f
  union all select path, 'Import', 'b/' || c || '.props', null, 8, 10, 7 from f
  union all select path, 'MSBuildTaskDeclaration', a, 'MSBuildTasks', 9, 3, 9 from f
  union all select path, 'Instantiation', 'N.' || a, 'lib', 9, 23, na + 2 from f
  union all select path, 'MSBuildTargetDeclaration', a, 'MSBuildTargets', 10, 16, na from f
  union all select path, 'MSBuildTargetUsage', b, 'MSBuildTargets', 10, na + 36, nb from f
  union all select path, 'MSBuildTaskUsage', 'CallTarget', 'MSBuildTasks', 11, 5, 10 from f where not cut
  union all select path, 'MSBuildTargetUsage', c, 'MSBuildTargets', 11, 25, nc from f where not cut
  union all select path, 'MSBuildItemAssignment', a, 'MSBuildItems', 12, 28, na from f where not cut
  union all select path, 'Unreadable', '', null, 10, 3, 0 from f where cut)"""


def _build_files(spark, sf_dir):
    a, b, c = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1), F.col("p_brand")
    head = "<Project>\n  <PropertyGroup>\n    <%aDependsOn>$(%b.Length);%c; x</%aDependsOn>\n  </PropertyGroup>\n  <ItemGroup>\n    <%b Include=\"@(%a->'%(Name)')\"><Link>%(Name)</Link></%b>\n  </ItemGroup>\n"
    head += "  <Import Project=\"b/%c.props\"/>\n  <UsingTask TaskName=\"N.%a\" AssemblyFile=\"c:\\t\\lib.dll\"/>\n  <Target Name=\"%a\" DependsOnTargets=\"%b\">\n"
    rest = "    <CallTarget Targets=\"%c\"/>\n    <Copy><Output ItemName=\"%a\"/></Copy>\n  </Target>\n</Project>"
    filled = lambda t: F.replace(F.replace(F.replace(F.lit(t), F.lit("%a"), a), F.lit("%b"), b), F.lit("%c"), c)
    whole = F.when(F.col("p_partkey") % 10 == 0, filled(head)).otherwise(F.concat(filled(head), filled(rest)))
    parts = dealt(_part(spark, sf_dir).select("p_partkey", "p_name", "p_brand"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("path"), whole.alias("text"))


@query("build_references", f"with {_BUILD} select path, kind, name, to_assembly, line, col_start, col_start + n as col_end from r union all select path, 'MSBuildTaskUsage', 'Copy', 'MSBuildTasks', 12, 5, 9 from f where not cut")
def _(spark, sf_dir):
    """A build file for each part with the places of its names; a broken one gives what it has, and a row that says so."""
    found = msbuild.build_references(_build_files(spark, sf_dir))
    name = F.when(F.col("kind") == msbuild.UNREADABLE, "").otherwise(F.col("name"))
    return found.select(F.col("path").cast("long").alias("path"), "kind", name.alias("name"), "to_assembly", "line", "col_start", "col_end")


@query(
    "build_reference_rows",
    f"""with {_BUILD}, l as (select path, 3 as line, '<' || a || 'DependsOn>$(' || b || '.Length);' || c || '; x</' || a || 'DependsOn>' as t from f
  union all select path, 9, '<UsingTask TaskName="N.' || a || '" AssemblyFile="c:\\t\\lib.dll"/>' from f)
select path, kind, name, line, md5(replace(replace(replace(t, '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) as html_md5 from r join l using (path, line) where to_assembly is not null""",
)
def _(spark, sf_dir):
    """References of build files with the escaped text of their lines, of the lines with a list and with a task."""
    rows = msbuild.reference_rows(_build_files(spark, sf_dir)).filter("line in (3, 9)")
    return rows.select(F.col("path").cast("long").alias("path"), "kind", "name", "line", F.md5(F.col("line_html").cast("binary")).alias("html_md5"))


@query("large_documents", "select doc_id, length(text) > 2000 as large from documents where text is not null")
def _(spark, sf_dir):
    d = td.read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.length("text").alias("chars"), F.lit(1).alias("lines"))
    return d.select("doc_id", spans.too_large(30_000, 2_000)[1].alias("large"))


@query("visited_lines", "select p_partkey, case when p_partkey % 3 = 0 then repeat('!', cast(p_partkey % 5 as int)) end as marks from part where p_partkey % 3 <> 1 union all select p_partkey, null from part where p_partkey % 3 = 1")
def _(spark, sf_dir):
    """A plug-in's marks by line; it fails on some lines, which then have none."""
    registry = Registry(settings={"loud": {"mark": "!"}})
    registry.add("loud", lambda s: {"text": lambda t, p, n: s["mark"] * n if p == "0" else [][0]})
    k = F.col("p_partkey")
    lines = _part(spark, sf_dir).select("p_partkey", F.col("p_name").alias("line_text"), (k % 3).cast("string").alias("path"), (k % 5).cast("int").alias("line"))
    marks = registry.visit_lines(lines)
    return marks.select("p_partkey", F.when(F.col("path") == "0", F.col("marks")).alias("marks"))


@query("visited_symbols", "select p_partkey, case p_type when 'ECONOMY' then upper(p_name) when 'LARGE' then reverse(p_name) else '' end as marks from part")
def _(spark, sf_dir):
    registry = Registry()
    registry.add("names", lambda s: {"symbols": {"ECONOMY": lambda n: n.upper(), "LARGE": lambda n: n[::-1]}})
    found = registry.visit_symbols(_part(spark, sf_dir).select("p_partkey", F.col("p_type").alias("kind"), F.col("p_name").alias("name")))
    return found.select("p_partkey", F.coalesce("marks", F.lit("")).alias("marks"))


@query("marked_reference_lines", "select p_partkey, '<i>' || split_part(p_name, ' ', 1) || '</i> &lt; <i>' || split_part(p_name, ' ', 2) || '</i>;' as html from part")
def _(spark, sf_dir):
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    t = F.concat(first, F.lit(" < "), second, F.lit(";"))
    at = F.length(first) + 3
    places = F.array(F.struct(F.lit(0).alias("col_start"), F.length(first).alias("col_end")), F.struct(at.alias("col_start"), (at + F.length(second)).alias("col_end")))
    return refs_.marked_lines(_part(spark, sf_dir).select("p_partkey", t.alias("line_text"), places.alias("occurrences"))).select("p_partkey", "html")
