"""The driver's tables seen as a code graph and its history.

Modules are nations; functions and classes are customers and suppliers, living in their nation; a call is a line of an order, from its
customer to its supplier; the imports of a module are the two nations it calls most. Commits are orders, the files
they touch are part brands, and the lines of a file are by suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c, s, n: lines of orders from a customer to a supplier."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return both.groupBy(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s")).agg(F.count("*").cast("long").alias("n"))


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file_path of functions (c<key>) and classes (s<key>): the nation's name."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("file_path"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("n_nationkey"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("n_nationkey"))
    return c.unionByName(s).join(F.broadcast(nation), "n_nationkey").select("id", "file_path")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select(F.concat(F.lit("c"), F.col("c").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("s").cast("string")).alias("dst"), F.lit("calls").alias("type"), F.col("n").alias("count"))


def nation_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type, count between nations' names, without those within one. Lines are summed by nation before names are joined."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("a"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("b"))
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c"))
    pairs = lines.join(s, "s").join(orders.join(c, "c"), "l_orderkey").where("a <> b").groupBy("a", "b").agg(F.count("*").cast("long").alias("count"))
    name = lambda k, out: F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(k), F.col("n_name").alias(out)))
    return pairs.join(name("a", "src"), "a").join(name("b", "dst"), "b").select("src", "dst", F.lit("calls").alias("type"), "count")


def nation_imports(spark: SparkSession, sf_dir: str, n: int = 2) -> DataFrame:
    """The n nations that each calls most, ties by name, as import edges of count 1."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("count"), "dst"))
    return nation_calls(spark, sf_dir).withColumn("r", rank).where(F.col("r") <= n).select("src", "dst", F.lit("imports").alias("type"), F.lit(1).cast("long").alias("count"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.lit("module").alias("type"), F.col("n_name").alias("file_path"), F.col("n_name").alias("name"), F.lit("tree").alias("source"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, seq, ts, path: orders and the brands they touch. Keys rise with time here, so the key is the place in history too."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("path"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("ts"))
    both = lines.join(part, "l_partkey").join(orders, "l_orderkey")
    return both.select(F.col("l_orderkey").alias("sha"), F.col("l_orderkey").alias("seq"), "ts", "path")


def blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, author, email, lines: brands by the suppliers of their lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("path"))
    by = lines.join(part, "l_partkey").groupBy("path", "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("lines"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("author"))
    return by.join(names, "l_suppkey").select("path", "author", F.concat(F.lower("author"), F.lit("@example.org")).alias("email"), "lines")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file_path, size: documents as files of a source tree, some in folders or of kinds that a scan passes over."""
    of = lambda n, *names: F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("doc_id") % n + 1).cast("int"))
    folder = of(7, "node_modules/a", "lib.egg-info", "src/core", "app", "dist", "app/deep/er", "web")
    suffix = of(11, ".py", ".JS", ".md", ".go", ".tsx", ".lock", ".java", "", ".kt", ".tar.rs", ".PYC")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(folder, F.lit("/"), "source", F.lit("_"), F.col("doc_id").cast("string"), suffix).alias("file_path"), (F.col("n_chars") * 100).cast("long").alias("size"))


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, language, text: parts as files of three languages that are read by line rules, with imports, functions, classes and statements."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    language = F.element_at(F.array(F.lit("go"), F.lit("java"), F.lit("rs")), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = F.concat(
        F.lit('import "lib/p'), size, F.lit('"\nfrom pkg'), size, F.lit(" import part_"), key, F.lit(", other\nfunc make_"), key, F.lit("(x int) {\n  if (x) {\n    return sell_"), key,
        F.lit("(x)\nstruct Part"), key, F.lit("\npublic static int price_"), key, F.lit("(int a) {\npublic class Hidden {\n"),
    )
    return table(spark, sf_dir, "part").select(F.concat(F.lit("parts/p"), key, F.lit("."), language).alias("file_path"), language.alias("language"), text.alias("text"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, content: a Python file for each nation. It imports the suppliers of the two nations it calls most, defines its own, and a
    function for each of its customers, who calls each supplier of its orders once: of its own file, of an imported one, or of one that is not."""
    path = lambda c: F.concat(F.lit("pkg/"), F.lower(c), F.lit(".py"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sup = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("s"), "n_name")
    name = lambda k, c: F.concat(F.lit(k), c.cast("string"))
    joined = lambda items, each, by: F.array_join(F.transform(F.array_sort(items), each), by)
    offered = sup.groupBy("n_name").agg(joined(F.collect_list("s"), lambda s: name("supplier_", s), ", ").alias("names"))
    imports = nation_imports(spark, sf_dir).join(offered.withColumnRenamed("n_name", "dst"), "dst")
    lines = imports.select(F.col("src").alias("n_name"), F.lit(0).alias("a"), "dst", F.lit(0).cast("long").alias("k"), F.concat(F.lit("from pkg."), F.lower("dst"), F.lit(" import "), "names").alias("line"))
    lines = lines.unionByName(sup.select("n_name", F.lit(1).alias("a"), F.lit("").alias("dst"), F.col("s").cast("long").alias("k"), F.concat(F.lit("def "), name("supplier_", F.col("s")), F.lit("():\n    pass")).alias("line")))
    made = calls(spark, sf_dir).groupBy("c").agg(joined(F.collect_set("s"), lambda s: F.concat(F.lit("    "), name("supplier_", s), F.lit("()")), "\n").alias("body"))
    cust = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("c"), "n_name").join(made, "c")
    lines = lines.unionByName(cust.select("n_name", F.lit(2).alias("a"), F.lit("").alias("dst"), F.col("c").cast("long").alias("k"), F.concat(F.lit("def "), name("customer_", F.col("c")), F.lit("():\n"), "body").alias("line")))
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "n_name")  # a number, so that adaptive execution doesn't give a task many files
    whole = lines.groupBy("n_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "dst", "k", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return nation.join(whole, "n_name", "left").select(path("n_name").alias("file_path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
