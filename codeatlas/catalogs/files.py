"""Files of every layout, written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, text
from ..operators import extract, references as refs_, search, selection
from ..registered import query
from ..runtime import new_folder
from ..sources import packed, readers, sinks, testdata as td


def _write(df: DataFrame, name: str, compression: str = "none") -> str:
    """The column ``value`` as a text file in a new folder; values may hold several lines."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).text(path)
    return path


def _touch(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.writeBytes("x\n")
    out.close()


def _maps(spark, sf_dir):
    k = td.keyed(spark, sf_dir)
    counts = td.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("assembly_name")).agg(F.count(F.lit(1)).cast("int").alias("referencing_count"))
    path = new_folder(spark, "maps")
    sinks.write_maps(k.join(counts, "assembly_name"), k.filter("project_key <> -1").select("project_key", "project_path"), path)
    return path


@query("assembly_map_lines", f"with {td.ASSEMBLIES_SQL} select assembly_number, assembly_name, project_key, cast(n as int) as referencing_count from keyed join (select p_brand as assembly_name, count(*) as n from part group by 1) c using (assembly_name)")
def _(spark, sf_dir):
    return readers.assembly_map(spark, _maps(spark, sf_dir) + "/assemblies")


@query("project_list_lines", f"with {td.ASSEMBLIES_SQL} select project_key, project_path from projects")
def _(spark, sf_dir):
    return readers.project_list(spark, _maps(spark, sf_dir) + "/projects")


@query("name_list_files", "select r_name as name from region")
def _(spark, sf_dir):
    folder = new_folder(spark, "names")
    for r in td.read(spark, sf_dir, "region").select("r_name").collect():
        _touch(spark, f"{folder}/{r[0]}.html")
    return readers.name_list(spark, folder)


@query("discovered_projects", "select n_name as project from nation where n_nationkey % 3 = 0")
def _(spark, sf_dir):
    """Folders of nations, of which each third one holds references."""
    folder = new_folder(spark, "roots")
    for name, key in td.read(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect():
        _touch(spark, f"{folder}/{name}/{'R' if key % 3 == 0 else 'S'}/x.txt")
    return spark.createDataFrame([(p,) for p in readers.discover(spark, folder)], "project string")


@query("symbol_lines_last_wins", "select cast(p_partkey % 150 as varchar) as symbol_id, arg_max(p_name, p_partkey) as name, 'class' as kind, arg_max(p_brand, p_partkey) as description, cast(arg_max(p_size, p_partkey) as int) as glyph from part where p_partkey % 10 <> 0 group by 1")
def _(spark, sf_dir):
    """Lines in the order of their keys; each tenth one is malformed, and ids come again."""
    k = F.col("p_partkey")
    line = F.concat_ws(";", "p_name", (k % 150).cast("string"), F.lit("class"), "p_brand", F.when(k % 10 != 0, F.col("p_size").cast("string")))
    lines = td.read(spark, sf_dir, "part").coalesce(1).sortWithinPartitions("p_partkey").select(line.alias("value"))
    return readers.symbol_lines(spark, _write(lines, "symbol-lines"))


@query("declaration_map_lines", "select p_brand as symbol_id, p_name || '.cs' as file, cast(p_partkey as bigint) as \"offset\" from part")
def _(spark, sf_dir):
    """A header line for each brand, over the lines of its parts."""
    line = F.concat("p_name", F.lit(".cs;"), F.col("p_partkey").cast("string"))
    brands = td.read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(line), "\n").alias("l"))
    return readers.declaration_map(spark, _write(brands.select(F.concat(F.lit("="), "p_brand", F.lit("\n"), "l").alias("value")), "declaration-map"))


@query("edge_lines", "select distinct cast(p_partkey % 50 as varchar) as member_id, p_brand as base_assembly, cast(p_size as varchar) as base_id from part where p_size % 7 <> 0")
def _(spark, sf_dir):
    line = F.concat_ws(";", (F.col("p_partkey") % 50).cast("string"), "p_brand", F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("string")))
    return readers.edges(spark, _write(td.read(spark, sf_dir, "part").select(line.alias("value")), "edges"))


@query("project_info_lines", "select n_name as project, cast(n_nationkey * 10 as bigint) as \"Lines\", cast(0 as bigint) as \"Docs\", cast(0 as bigint) as \"Missing\" from nation")
def _(spark, sf_dir):
    """A file for each nation: a number, the same name again, and one that is no number."""
    path = new_folder(spark, "project-info")
    value = F.concat(F.lit("Lines="), (F.col("n_nationkey") * 10).cast("string"), F.lit("\nLines=7\nDocs=many"))
    td.read(spark, sf_dir, "nation").select("n_name", value.alias("value")).write.partitionBy("n_name").text(path)
    info = readers.project_info(spark, path, ["Lines", "Docs", "Missing"])
    return info.select(F.regexp_extract("file", "n_name=([^/]+)/", 1).alias("project"), "Lines", "Docs", "Missing")


@query("reference_record_lines", f"with {td.REFS_SQL} select from_assembly, '../' || from_path || '.html' as url, from_path, cast(line as int) as line, col_start, col_end, kind, 'code of ' || to_name as line_text from refs")
def _(spark, sf_dir):
    """Records of two lines in as many files as there are tasks."""
    number = [F.col(c).cast("string") for c in ("line", "col_start", "col_end", "kind")]
    head = F.concat_ws(";", "from_assembly", F.concat(F.lit("../"), "from_path", F.lit(".html")), "from_path", *number)
    record = F.concat(head, F.lit("\ncode of "), "to_name")
    return readers.reference_records(spark, _write(td.references(spark, sf_dir).select(record.alias("value")), "records", "gzip")).drop("to_symbol_id")


@query("invocation_lines", "select 'p' || o_orderkey || '.csproj' as project, 'obj/' || o_orderkey || '.dll' as output, '/out:' || o_custkey as command_line from orders")
def _(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    record = F.concat(F.lit("p"), k, F.lit(".csproj\nobj/"), k, F.lit(".dll\n/out:"), F.col("o_custkey").cast("string"))
    return readers.invocations(spark, _write(td.read(spark, sf_dir, "orders").select(record.alias("value")), "invocations"))


@query("documentation_members", "select 'T:' || (p_partkey % 97) as member_id, arg_max('<member name=\"T:' || (p_partkey % 97) || '\">' || chr(10) || '  <summary>' || p_name || '</summary>' || chr(10) || '</member>', p_partkey) as xml from part group by 1")
def _(spark, sf_dir):
    """Members over several lines, ids again."""
    xml = F.concat(F.lit('<member name="T:'), (F.col("p_partkey") % 97).cast("string"), F.lit('">\n  <summary>'), "p_name", F.lit("</summary>\n</member>"))
    return readers.documentation(spark, _write(td.read(spark, sf_dir, "part").coalesce(1).sortWithinPartitions("p_partkey").select(xml.alias("value")), "documentation"))


@query("federated_lines", "select cast(n_regionkey % 2 as int) as server_index, 's' || (n_regionkey % 2) as server, lower(n_name) as assembly_name from nation")
def _(spark, sf_dir):
    n = td.read(spark, sf_dir, "nation")
    line = F.concat(F.lower("n_name"), F.lit(";"), F.col("n_nationkey").cast("string")).alias("value")
    return readers.federation(spark, [(f"s{k}", _write(n.filter(F.col("n_regionkey") % 2 == k).select(line), f"federation-{k}")) for k in (0, 1)])


@query(
    "analyzed_ranges",
    """with w as (select p_partkey, p_size, cast(length(split_part(p_name, ' ', 1)) as int) as a, cast(length(p_name) as int) as n from part),
r as (select p_partkey, 0 as start, a as length, 'keyword' as classification from w union all select p_partkey, a + 1, n - a - 1, 'identifier' from w union all select p_partkey, 0, n, 'class name' from w where p_size % 2 = 1)
select cast(p_partkey as varchar) as file, start, length, classification from r""",
)
def _(spark, sf_dir):
    """An analyzer's output for each part: the words of its name, and the whole name as a semantic range where its size is odd."""
    first, n = F.length(F.substring_index("p_name", " ", 1)), F.length("p_name")
    of = lambda a, k, c: F.struct(a.alias("start"), k.alias("length"), F.lit(c).alias("classification"))
    words = F.array(of(F.lit(0), first, "keyword"), of(first + 1, n - first - 1, "identifier"))
    semantic = F.when(F.col("p_size") % 2 == 1, F.array(of(F.lit(0), n, "class name")))
    one = F.struct(F.col("p_partkey").cast("string").alias("fileName"), words.alias("syntacticClassifications"), semantic.alias("semanticClassifications"))
    read = readers.analyzed_files(spark, _write(td.read(spark, sf_dir, "part").select(F.to_json(one).alias("value")), "analyzed"), lines=True)
    both = F.concat("syntacticClassifications", F.coalesce("semanticClassifications", F.array().cast(read.schema["semanticClassifications"].dataType)))
    return read.select(F.col("fileName").alias("file"), F.explode(both).alias("r")).select("file", "r.start", "r.length", "r.classification")


@query("packed_symbols", f"with {td.SYMBOLS_SQL} select assembly_number, cast(kind_rank * 40 as int) as glyph, name, symbol_id, description from symbols")
def _(spark, sf_dir):
    """Symbols through the packed layout of their assemblies, descriptions coded by the frequencies of their pairs."""
    s = td.symbols(spark, sf_dir).withColumn("glyph", (F.col("kind_rank") * 40).cast("int"))
    path = new_folder(spark, "packed")
    packed.write_symbols(s, path, _counts(s))
    return packed.read_symbols(spark, path)


@query("packed_assembly_names", f"with {td.SYMBOLS_SQL} select name, symbol_id from symbols where assembly_number between 3 and 5")
def _(spark, sf_dir):
    """Names of a range of assemblies out of packed files: descriptions are never expanded."""
    path = new_folder(spark, "packed")
    packed.write_symbols(td.symbols(spark, sf_dir).withColumn("glyph", (F.col("kind_rank") * 40).cast("int")), path)
    rows = packed.read_symbols(spark, path, ["assembly_number", "name", "symbol_id"])
    return rows.filter("assembly_number between 3 and 5").select("name", "symbol_id")


def _counts(symbols: DataFrame) -> dict[str, int]:
    """The table of pairs as what a code is built from: 2^14 rows at most."""
    return {r["pair"]: r["n"] for r in _pairs(symbols).collect()}


def _pairs(symbols: DataFrame) -> DataFrame:
    """How often each pair of characters occurs at an even place, with the pair that ends a text."""
    d = F.col("description")
    places = F.sequence(F.lit(1), F.length(d) + 1, F.lit(2))
    pairs = F.transform(places, lambda k: F.rpad(F.substring(d, k, F.lit(2)), 2, codec.END))
    return symbols.filter(d.rlike(r"^[\x00-\x7f]*$")).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query("description_codec", f"with {td.SYMBOLS_SQL} select symbol_id, description, true as shorter from symbols")
def _(spark, sf_dir):
    """Descriptions coded and expanded again."""
    s = td.symbols(spark, sf_dir).select("symbol_id", "description")
    counts = _counts(s)

    def both(d: str) -> list[str]:
        c = codec.Codec(counts) if not _CODECS else _CODECS[0]
        _CODECS[:] = [c]
        data = c.compress(d)
        return [c.expand(data), str(len(data) < len(d))]

    coded = text.arrow(both, "array<string>")(F.col("description"))
    return s.withColumn("c", coded).select("symbol_id", F.col("c")[0].alias("description"), (F.col("c")[1] == "True").alias("shorter"))


_CODECS: list[codec.Codec] = []


@query("codec_pairs", f"with {td.SYMBOLS_SQL} select pair, count(*) as n from (select unnest(list_transform(range(1, length(description) + 2, 2), lambda i: substr(description, cast(i as int), 2) || repeat('~', cast(2 - least(2, greatest(0, length(description) - i + 1)) as int)))) as pair from symbols) t group by pair")
def _(spark, sf_dir):
    """The table that the code is built from; ends are shown as ``~``."""
    return _pairs(td.symbols(spark, sf_dir)).withColumn("pair", F.translate("pair", codec.END, "~"))


@query(
    "stored_prefix_search",
    f"with {td.SYMBOLS_SQL} select name, kind, assembly_name, symbol_id, match_level * 10 + kind_rank as weight from (select *, case when name = 'small' then 1 when name_fold = 'SMALL' then 2 when starts_with(name, 'small') then 3 else 4 end as match_level from (select * from symbols where starts_with(name_fold, 'SMALL') order by name_fold, kind_rank, name, assembly_number, symbol_id limit 100) x) y",
)
def _(spark, sf_dir):
    """A search over the stored index, whose scan gets the prefix."""
    path = new_folder(spark, "index")
    sinks.write_symbols(td.symbols(spark, sf_dir), path)
    return search.search_symbols(spark.read.parquet(path), "small").select("name", "kind", "assembly_name", "symbol_id", "weight")


@query("stored_name_search", "select name from (select distinct p_name as name from part) t where starts_with(name, 'red') order by name limit 100")
def _(spark, sf_dir):
    """A list search over stored names, whose scan gets the prefix."""
    path = new_folder(spark, "name-list")
    sinks.write_names(td.read(spark, sf_dir, "part"), "p_name", path)
    return search.search_names(spark.read.parquet(path), "name", "Red")


@query("stored_references", f"with {td.REFS_SQL} select to_symbol_id, kind, count(*) as n from refs where to_assembly = 'NATION_3' group by 1, 2")
def _(spark, sf_dir):
    """One assembly's references out of the stored ones."""
    path = new_folder(spark, "references")
    sinks.write_references(td.references(spark, sf_dir), path)
    return spark.read.parquet(path).filter("to_assembly = 'NATION_3'").groupBy("to_symbol_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("stored_declarations", f"with {td.SYMBOLS_SQL} select assembly_name, count(*) as n, min(name) as first from symbols group by 1")
def _(spark, sf_dir):
    path = new_folder(spark, "declarations")
    sinks.write_declarations(td.symbols(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("assembly_name").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))


@query("stored_redirects", f"with {td.REFS_SQL} select substr(to_symbol_id, 1, 1) as bucket, count(*) as n from (select distinct to_symbol_id from refs) t group by 1")
def _(spark, sf_dir):
    path = new_folder(spark, "redirects")
    places = td.references(spark, sf_dir).select(F.col("to_symbol_id").alias("symbol_id"), F.col("from_path").alias("file"))
    sinks.write_redirects(search.redirects(places), path)
    stored = spark.read.schema("key string, symbol_id string, files long, file string, bucket string").parquet(path)
    return stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("rejected_rows", "select p_size % 7 <> 0 and p_brand <> 'Brand#3' as good, count(*) as n from part group by 1")
def _(spark, sf_dir):
    good, bad = sinks.with_rejects(td.read(spark, sf_dir, "part"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand") != "Brand#3"))
    return good.select(F.lit(True).alias("good")).unionByName(bad.select(F.lit(False).alias("good"))).groupBy("good").agg(F.count(F.lit(1)).alias("n"))


@query("diagnostic_lines", "select p_brand as project, case when p_size % 2 = 0 then 'warning' else 'error' end || ' CS' || p_size || ': ' || p_name as line from part where p_size < 10")
def _(spark, sf_dir):
    path = new_folder(spark, "diagnostics")
    p = td.read(spark, sf_dir, "part").filter("p_size < 10")
    severity = F.when(F.col("p_size") % 2 == 0, "warning").otherwise("error")
    rows = p.select(F.col("p_brand").alias("project"), severity.alias("severity"), F.concat(F.lit("CS"), F.col("p_size").cast("string")).alias("code"), F.col("p_name").alias("message"))
    sinks.write_diagnostics(rows, path)
    return spark.read.schema("value string, project string").text(path).select("project", F.col("value").alias("line"))


@query("manifest_expired", "select o_custkey, name from (select o_custkey, o_custkey || '/' || strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey as name, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) t where rn > 10")
def _(spark, sf_dir):
    """Archives appended to the manifest in two parts, and those to delete, beyond the ten newest of each."""
    path = new_folder(spark, "manifest")
    o = td.read(spark, sf_dir, "orders")
    name = F.concat(F.col("o_custkey").cast("string"), F.lit("/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.col("o_orderkey").cast("string"))
    rows = o.select(F.col("o_custkey").alias("repository"), name.alias("name"), "o_orderkey")
    for k in (0, 1):
        sinks.append_manifest(rows.filter(F.col("o_orderkey") % 2 == k), path)
    kept = spark.read.parquet(path).withColumn("key", F.regexp_extract("name", "-([0-9]+)$", 1).cast("long")).withColumn("date", F.regexp_extract("name", "/(.*)-[0-9]+$", 1))
    return selection.retention(kept, "repository", [F.desc("date"), F.desc("key")]).filter("expired").select(F.col("repository").alias("o_custkey"), "name")


@query("published_index", "select n_name as name from nation where n_nationkey >= 5")
def _(spark, sf_dir):
    """The second version of an index, read after it has taken the first one's place."""
    root = new_folder(spark, "published")
    names = td.read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    for version, low in ((1, 0), (2, 5)):
        sinks.publish(names.filter(F.col("n_nationkey") >= low).select("name"), root, version)
    return readers.current(spark, root)


@query("project_documents", "select c_name as name from (select 'doc' || c_custkey || '.cs' as c_name from customer where c_custkey % 2 = 0 union all select 'gen' || c_custkey || '.cs' from customer where c_custkey % 5 = 0 union all select 'attributes.cs' from customer where c_custkey = 1) t where c_name <> 'attributes.cs'")
def _(spark, sf_dir):
    c = td.read(spark, sf_dir, "customer")
    named = lambda prefix, rows: rows.select(F.concat(F.lit(prefix), F.col("c_custkey").cast("string"), F.lit(".cs")).alias("name"))
    own = named("doc", c.filter("c_custkey % 2 = 0")).unionByName(c.filter("c_custkey = 1").select(F.lit("attributes.cs").alias("name")))
    return readers.project_documents(own, named("gen", c.filter("c_custkey % 5 = 0")), "attributes")


@query("item_documents", "select distinct p_brand as project, p_name as include, case when p_type = 'SMALL' then 'script' else 'xml' end as reader from part where p_type in ('ECONOMY', 'LARGE', 'PROMO', 'SMALL')")
def _(spark, sf_dir):
    types = {"ECONOMY": "Resource", "LARGE": "Page", "PROMO": "EmbeddedResource", "SMALL": "TypeScriptCompile"}
    kind = F.coalesce(*(F.when(F.col("p_type") == a, b) for a, b in types.items()), F.lit("Compile"))
    return readers.item_documents(td.read(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), kind.alias("item_type"), F.col("p_name").alias("include")))


@query("unresolved_references", f"with {td.EDGES_SQL} select from_assembly as assembly, to_assembly as reference, n_nationkey < 20 as resolved from edges join nation on n_name = to_assembly")
def _(spark, sf_dir):
    e = td.assembly_edges(spark, sf_dir).select(F.col("from_assembly").alias("assembly"), F.col("to_assembly").alias("reference"))
    there, missing = readers.referenced_assemblies(e, td.read(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_name").alias("assembly")))
    return there.withColumn("resolved", F.lit(True)).unionByName(missing.withColumn("resolved", F.lit(False))).select("assembly", "reference", "resolved")


@query("managed_files", "select p_partkey, p_size % 3 <> 0 and p_type <> 'SMALL' as managed from part")
def _(spark, sf_dir):
    """Executables made of the parts: their headers lie as deep as the size says, a third has no runtime header, and small ones are cut off."""
    zeros = lambda n: F.repeat(F.lit("00"), n)
    number = lambda n: F.concat(F.lpad(F.hex(n), 2, "0"), F.lit("000000"))
    size, wide = F.col("p_size"), F.col("p_partkey") % 2 == 1
    head = F.concat(F.lit("4D5A"), zeros(F.lit(0x3A)), number(size + 0x40), zeros(size), F.lit("50450000"), zeros(F.lit(20)))
    middle = F.concat(F.when(wide, "0B02").otherwise("0B01"), zeros(F.when(wide, 110).otherwise(94) + 14 * 8))
    whole = F.concat(head, middle, F.when(F.col("p_type") == "SMALL", "").otherwise(number(size % 3)))
    return td.read(spark, sf_dir, "part").select("p_partkey", readers.is_managed(F.unhex(whole)).alias("managed"))


@query("stored_mart", f"with {td.EDGES_SQL} select to_assembly, count(*) as n from edges group by 1")
def _(spark, sf_dir):
    path = new_folder(spark, "mart")
    sinks.write_mart(td.assembly_edges(spark, sf_dir).groupBy("to_assembly").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.parquet(path)


@query("document_pages", "select p_partkey, '<span class=\"k\">' || split_part(p_name, ' ', 1) || '</span> <a href=\"/' || p_brand || '\">' || split_part(p_name, ' ', 2) || '</a>' as html from part")
def _(spark, sf_dir):
    """A part's name as a document of three spans: a keyword, a gap, and a link."""
    n, first, second = F.col("p_name"), F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    none = F.lit(None).cast("string")
    of = lambda start, t, style, href: F.struct(start.alias("start"), t.alias("text"), style.alias("style"), href.alias("href"))
    parts = F.array(of(F.length(first) + 1, second, none, F.concat(F.lit("/"), "p_brand")), of(F.lit(0), first, F.lit("k"), none), of(F.length(first), F.lit(" "), none, none))
    spans = td.read(spark, sf_dir, "part").filter(n.isNotNull()).select("p_partkey", F.explode(parts).alias("s")).select("p_partkey", "s.*")
    return extract.document_html(spans, "p_partkey")


@query(
    "reference_page",
    f"""with {td.REFS_SQL}, l as (select to_symbol_id, kind, from_assembly, from_path, line, count(*) as n from refs group by all),
f as (select to_symbol_id, kind, from_assembly, from_path, cast(sum(n) as bigint) as n, count(*) as lines, min(line) as first_line from l group by all),
a as (select to_symbol_id, kind, from_assembly, count(*) as assembly_n from refs group by all), k as (select to_symbol_id, kind, count(*) as kind_n from refs group by all)
select f.*, assembly_n, kind_n from f join a using (to_symbol_id, kind, from_assembly) join k using (to_symbol_id, kind)""",
)
def _(spark, sf_dir):
    p = refs_.page(td.references(spark, sf_dir))
    first = F.col("lines")[0]["line"].alias("first_line")
    return p.select("to_symbol_id", "kind", "from_assembly", "from_path", "n", F.size("lines").cast("long").alias("lines"), first, "assembly_n", "kind_n")
