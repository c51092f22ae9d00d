"""The driver's tables seen as code relations.

Parts stand for symbols, line items for references, nations for assemblies, events
for build events.  Only the columns a relation needs are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folding import fold, fold_sql
from ..functions.ids import symbol_id
from ..functions.kinds import kind_rank

# Part types as symbol kinds.
KIND_OF_TYPE = {"ECONOMY": "class", "LARGE": "struct", "MEDIUM": "interface", "PROMO": "method", "SMALL": "property"}
REFERENCE_KINDS = 19


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assemblies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered in name order; one per brand, so the ordering window is over a small dimension."""
    from ..operators.numbering import ordinal_keys

    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("assembly_name")).distinct()
    out = ordinal_keys(brands, "assembly_name", "assembly_number")
    return out.withColumn("project_path", F.when(F.col("assembly_name") != "Brand#7", F.concat(F.lit("src/"), "assembly_name", F.lit(".csproj"))))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    kind = F.lit("field")
    for p_type, k in KIND_OF_TYPE.items():
        kind = F.when(F.col("p_type") == p_type, k).otherwise(kind)
    is_file = (F.col("p_type") == "STANDARD") & (F.col("p_size") % 2 == 1)
    name = F.when(is_file, F.concat(F.substring_index("p_name", " ", 1), F.lit(".cs"))).otherwise(F.col("p_name"))
    described = F.concat("p_brand", F.lit("."), "p_type", F.lit("."), "p_name", F.lit("("), F.col("p_size").cast("string"), F.lit(")"))
    rows = part.select(
        F.col("p_brand").alias("assembly_name"),
        name.alias("name"),
        F.when(is_file, "file").otherwise(kind).alias("kind"),
        described.alias("description"),
        symbol_id(F.concat(F.lit("T:"), F.col("p_partkey").cast("string"))).alias("symbol_id"),
    )
    # A brand's project is its own, also that of the brand without one in ``assemblies``.
    numbered = rows.join(assemblies(spark, sf_dir).select("assembly_name", "assembly_number"), "assembly_name")
    return searchable(numbered.withColumn("project_path", F.concat(F.lit("src\\"), "assembly_name", F.lit("\\"), "assembly_name", F.lit(".csproj"))))


def searchable(df: DataFrame) -> DataFrame:
    """With the stored columns that searches push down to."""
    return (
        df.withColumn("name_fold", fold("name"))
        .withColumn("assembly_fold", fold("assembly_name"))
        .withColumn("project_fold", fold("project_path"))
        .withColumn("desc_fold", fold(F.substring_index("description", "(", 1)))
        .withColumn("kind_rank", kind_rank(F.col("kind")))
    )


SYMBOLS_SQL = f"""symbols as (
  select *, {fold_sql("name")} as name_fold, {fold_sql("assembly_name")} as assembly_fold, {fold_sql("project_path")} as project_fold,
         {fold_sql("split_part(description, '(', 1)")} as desc_fold,
         case when kind in ('class','struct','interface','enum','delegate') then 1 when kind = 'field' then 3 when kind = 'file' then 4 else 2 end as kind_rank
  from (select cast(dense_rank() over (order by p_brand) - 1 as int) as assembly_number, p_brand as assembly_name,
               concat('src\\', p_brand, '\\', p_brand, '.csproj') as project_path,
               case when p_type = 'STANDARD' and p_size % 2 = 1 then split_part(p_name, ' ', 1) || '.cs' else p_name end as name,
               case when p_type = 'STANDARD' and p_size % 2 = 1 then 'file' else case p_type when 'ECONOMY' then 'class' when 'LARGE' then 'struct' when 'MEDIUM' then 'interface' when 'PROMO' then 'method' when 'SMALL' then 'property' else 'field' end end as kind,
               concat(p_brand, '.', p_type, '.', p_name, '(', cast(p_size as varchar), ')') as description,
               substr(md5(concat('T:', cast(p_partkey as varchar))), 1, 16) as symbol_id
        from part) t)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, customer = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    start = F.col("l_quantity").cast("int")
    source = nation.select(F.col("n_nationkey").alias("cn"), F.col("n_name").alias("from_assembly"))
    target = nation.select(F.col("n_nationkey").alias("sn"), F.col("n_name").alias("to_assembly"))
    callers = orders.select("o_orderkey", "o_custkey").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
        .join(callers, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(source, F.col("c_nationkey") == F.col("cn"))
        .join(target, F.col("s_nationkey") == F.col("sn"))
    )
    return joined.select(
        "to_assembly",
        symbol_id(F.concat(F.lit("T:"), F.col("l_partkey").cast("string"))).alias("to_symbol_id"),
        "from_assembly",
        F.concat(F.lit("f"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".cs")).alias("from_path"),
        F.col("l_linenumber").alias("line"),
        start.alias("col_start"),
        (start + 8).alias("col_end"),
        ((F.col("l_partkey") + F.col("l_linenumber")) % REFERENCE_KINDS).cast("int").alias("kind"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
        F.when(F.col("l_linenumber") == 1, "base").otherwise(F.concat(F.lit("S"), F.col("l_partkey").cast("string"))).alias("to_name"),
    )


REFS_SQL = f"""refs as (
  select sn.n_name as to_assembly, substr(md5(concat('T:', cast(l.l_partkey as varchar))), 1, 16) as to_symbol_id, cn.n_name as from_assembly,
         concat('f', cast(o.o_orderkey % 50 as varchar), '.cs') as from_path, l.l_linenumber as line,
         cast(trunc(l.l_quantity) as int) as col_start, cast(trunc(l.l_quantity) as int) + 8 as col_end,
         cast((l.l_partkey + l.l_linenumber) % {REFERENCE_KINDS} as int) as kind,
         l.l_orderkey * 100 + l.l_linenumber as seq,
         case when l.l_linenumber = 1 then 'base' else concat('S', cast(l.l_partkey as varchar)) end as to_name
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey
  join nation cn on c.c_nationkey = cn.n_nationkey join supplier s on l.l_suppkey = s.s_suppkey join nation sn on s.s_nationkey = sn.n_nationkey)"""


def assembly_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which assembly refers to which other."""
    return references(spark, sf_dir).filter("from_assembly <> to_assembly").select("from_assembly", "to_assembly").distinct()


EDGES_SQL = REFS_SQL + ", edges as (select distinct from_assembly, to_assembly from refs where from_assembly <> to_assembly)"


def build_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as target starts and clicks as command lines, by user."""
    kind = F.when(F.col("event_type") == "signup", "TargetStarted").when(F.col("event_type") == "click", "TaskCommandLine").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("key"), kind.alias("event_type"), F.get_json_object("props", "$.k").alias("value")
    )


ASSEMBLIES_SQL = """assemblies as (
  select p_brand as assembly_name, case when p_brand <> 'Brand#7' then 'src/' || p_brand || '.csproj' end as project_path,
         cast(row_number() over (order by p_brand) - 1 as int) as assembly_number from (select distinct p_brand from part) d),
projects as (select project_path, cast(row_number() over (order by project_path) - 1 as int) as project_key from assemblies where project_path is not null),
keyed as (select a.assembly_name, a.assembly_number, a.project_path, coalesce(p.project_key, -1) as project_key from assemblies a left join projects p using (project_path))"""


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assemblies with number and project key."""
    from ..operators.numbering import project_keys

    a = assemblies(spark, sf_dir)
    return project_keys(a).join(a.select("assembly_name", "assembly_number"), "assembly_name")
