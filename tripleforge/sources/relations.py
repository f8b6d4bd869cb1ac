"""Sources: the triple view over the driver's tables, N-Triples, SPARQL bindings, sample files, and names of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.patterns import DOM, RAN, SC, SP, TY

PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
#: Schema triples of the view.
SCHEMA = (
    ("placedBy", DOM, "Order"), ("containsPart", DOM, "Order"), ("suppliedBy", DOM, "Order"), ("inNation", DOM, "Party"), ("inRegion", DOM, "Nation"),
    ("placedBy", RAN, "Customer"), ("containsPart", RAN, "Part"), ("suppliedBy", RAN, "Supplier"), ("inNation", RAN, "Nation"), ("inRegion", RAN, "Region"),
    ("placedBy", SP, "relatedTo"), ("relatedTo", SP, "linkedTo"), ("containsPart", SP, "relatedTo"), ("suppliedBy", SP, "involves"), ("involves", SP, "linkedTo"),
    ("inNation", SP, "locatedIn"), ("locatedIn", SP, "linkedTo"), ("inRegion", SP, "locatedIn"),
    ("Order", SC, "Document"), ("Document", SC, "Record"), ("Record", SC, "Thing"), ("Customer", SC, "Party"), ("Party", SC, "Agent"), ("Agent", SC, "Thing"), ("Supplier", SC, "Organisation"),
    ("Organisation", SC, "Thing"), ("Part", SC, "Product"), ("Product", SC, "Thing"), ("Nation", SC, "Place"), ("Region", SC, "Area"), ("Area", SC, "Thing"), ("Place", SC, "Thing"),
    *((t, SC, "Part") for t in PART_TYPES),
)


def values(spark: SparkSession, rows, columns: str) -> DataFrame:
    """Rows of texts as a table whose size the planner knows, so that it is joined by broadcast."""
    quote = lambda x: "CAST(NULL AS STRING)" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)} AS t({columns})")


def triple_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o) over the driver's tables, as a set: facts of orders, their lines, customers, suppliers and nations, types, and SCHEMA."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    name = lambda kind, col: F.concat(F.lit(f"{kind}_"), F.col(col).cast("string"))
    fact = lambda d, s, p, o: d.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    parts = [
        fact(t("orders"), name("Order", "o_orderkey"), "placedBy", name("Customer", "o_custkey")),
        fact(t("lineitem").select("l_orderkey", "l_partkey").distinct(), name("Order", "l_orderkey"), "containsPart", name("Part", "l_partkey")),
        fact(t("lineitem").select("l_orderkey", "l_suppkey").distinct(), name("Order", "l_orderkey"), "suppliedBy", name("Supplier", "l_suppkey")),
        fact(t("customer"), name("Customer", "c_custkey"), "inNation", name("Nation", "c_nationkey")),
        fact(t("supplier"), name("Supplier", "s_suppkey"), "inNation", name("Nation", "s_nationkey")),
        fact(t("nation"), name("Nation", "n_nationkey"), "inRegion", name("Region", "n_regionkey")),
        fact(t("customer"), name("Customer", "c_custkey"), TY, F.lit("Customer")),
        fact(t("supplier"), name("Supplier", "s_suppkey"), TY, F.lit("Supplier")),
        fact(t("part"), name("Part", "p_partkey"), TY, F.col("p_type")),
        values(spark, SCHEMA, "s, p, o"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def hierarchies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o) of class and property hierarchies that grow with the tables, as a set, to stand beside `triple_view`.

    Classes: an item under its brand, a brand under the types that it comes in; a buyer under the one of half its number and
    its market, a market under its zone, and a zone, in a cycle, under its markets of numbers that five divides. Properties:
    a buyer's under the one of half its number, a supplier's under its nation's, that under its region's.
    """
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    name = lambda kind, e: F.concat(F.lit(f"{kind}_"), F.expr(e).cast("string"))
    pair = lambda d, s, p, o: d.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    later = t("customer").where("c_custkey > 0")
    parts = [
        pair(t("part"), name("Item", "p_partkey"), SC, F.col("p_brand")),
        pair(t("part").select("p_brand", "p_type").distinct(), F.col("p_brand"), SC, F.col("p_type")),
        pair(later, name("Buyer", "c_custkey"), SC, name("Buyer", "c_custkey div 2")),
        pair(t("customer"), name("Buyer", "c_custkey"), SC, name("Market", "c_nationkey")),
        pair(t("nation"), name("Market", "n_nationkey"), SC, name("Zone", "n_regionkey")),
        pair(t("nation").where("n_nationkey % 5 = 0"), name("Zone", "n_regionkey"), SC, name("Market", "n_nationkey")),
        pair(later, name("orderedAs", "c_custkey"), SP, name("orderedAs", "c_custkey div 2")),
        pair(t("supplier"), name("servedBy", "s_suppkey"), SP, name("servedIn", "s_nationkey")),
        pair(t("nation"), name("servedIn", "n_nationkey"), SP, name("servedWithin", "n_regionkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def bindings(df: DataFrame, fields: list[str], row_filter: Column | None = None) -> DataFrame:
    """SPARQL bindings (a map from variable to struct(value)) as columns; rows that lack a field are dropped."""
    out = df.select(*[F.col("binding")[f]["value"].alias(f) for f in fields]).dropna(subset=fields)
    return out if row_filter is None else out.where(row_filter)


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of the lines that are triples of IRIs."""
    line = F.regexp_extract
    at = r"^<([^>]*)>\s+<([^>]*)>\s+<([^>]*)>"
    rows = spark.read.text(path).where(F.col("value").rlike(at))
    return rows.select(*[line("value", at, i).alias(c) for i, c in ((1, "s"), (2, "p"), (3, "o"))])


def subproperty_pairs(triples: DataFrame, namespace: str = "https://schema.org/") -> DataFrame:
    """(child, parent) local names of subPropertyOf triples within a namespace."""
    local = lambda c: F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1)
    rows = triples.where(F.col("p").endswith("subPropertyOf") & F.col("s").startswith(namespace) & F.col("o").startswith(namespace))
    return rows.select(local("s").alias("child"), local("o").alias("parent")).where("child <> parent")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Entries of sample or dataset files {metadata, entries}, with pos, the file, and the metadata as columns."""
    rows = spark.read.json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("file"))
    return rows.select("file", "metadata", F.posexplode("entries").alias("pos", "entry")).select("file", "pos", "metadata.*", "entry.*")


def sample_of(spark: SparkSession, root: str, files: dict[str, str], pattern: str) -> DataFrame:
    """The sample of a pattern by the configured table of files; a pattern or file that is not there is an error."""
    if pattern not in files:
        raise FileNotFoundError(f"no sample is configured for {pattern}")
    at = f"{root}/{files[pattern]}"
    if not _exists(spark, at):
        raise FileNotFoundError(at)
    return samples(spark, at)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def jsonl(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(file, pos, value) of the lines that are not blank, of all files under path; pos counts all lines of the file from 0, blank ones too.

    Files are read by blocks in as many tasks as their size asks for. A block's rows stand in order in one partition, so a
    line's place is its row's less that of the block's first, plus the lines of the blocks before, which a window over
    blocks, not lines, adds up. Both reads of the files cut them alike; files must not change meanwhile.
    """
    source = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    lines = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    return lines.join(shift, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("pos"), "value").where(F.trim("value") != "")


def scores(spark: SparkSession, path: str) -> DataFrame:
    """A canonical CSV of scores: counts as numbers, metrics in units of 1e-12, empty ones null."""
    rows = spark.read.csv(path, header=True, nullValue="", emptyValue="")
    whole, metric = ("n_total", "n_correct", "n_rule"), ("accuracy", "precision_triple", "recall_triple", "f1_triple", "precision_rule", "recall_rule", "f1_rule")
    pico = lambda c: (F.col(c).cast("decimal(13,12)") * F.lit(10**12).cast("decimal(13,0)")).cast("long")
    return rows.select(*[F.col(c).cast("long").alias(c) if c in whole else pico(c).alias(c) if c in metric else F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


# --- configurations: small dictionaries on the driver ---


def runner_models(config: dict[str, dict], runner: str, whole: bool) -> dict[str, dict]:
    """Models whose runner is the given one (whole) or starts with it."""
    return {m: v for m, v in config.items() if (v.get("runner", "") == runner if whole else v.get("runner", "").startswith(runner))}


def prices(spark: SparkSession, config: dict[str, dict]) -> DataFrame:
    """model, input_per_1m, output_per_1m; keys that start with an underscore are notes."""
    rows = [(m, float(v.get("input_per_1m", 0)), float(v.get("output_per_1m", 0))) for m, v in config.items() if not m.startswith("_")]
    return spark.createDataFrame(rows, "model string, input_per_1m double, output_per_1m double")


def validation_files(config: dict[str, str], patterns: list[str] | None = None) -> list[tuple[str, str]]:
    """(pattern, file) of the chosen patterns, all by default; one that is not configured is an error."""
    chosen = [p.strip() for p in patterns if p.strip()] if patterns else list(config)
    if missing := [p for p in chosen if p not in config]:
        raise ValueError(f"patterns without a file: {missing}")
    return [(p, config[p]) for p in chosen]
