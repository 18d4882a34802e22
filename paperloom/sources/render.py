"""Documents rendered from the star schema: an invoice per order, a letter per nation, with dense dates, amounts and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (the order's key) and text. Money is in integer cents until it is written."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("bigint")
    lines = read("lineitem").groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("net"), F.count("*").alias("n"))
    orders = read("orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd").alias("due"))
    customers = read("customer").select("c_custkey", "c_name")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    net = F.coalesce("net", F.lit(0))
    tax = F.floor(net * 8 / 100).cast("bigint")
    money = lambda c: F.concat(F.floor(c / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    text = F.concat(
        F.lit("INVOICE\nInvoice Number: INV-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"),
        F.lit("\nInvoice Date: "), F.col("day"), F.lit("\nDue Date: "), F.col("due"),
        F.lit("\nBill To: "), F.coalesce("c_name", F.lit("nobody")),
        F.lit("\nLine items: "), F.coalesce("n", F.lit(0)).cast("string"),
        F.lit("\nSubtotal: $"), money(net), F.lit("\nTax: $"), money(tax), F.lit("\nTotal: $"), money(net + tax),
        F.lit("\nPlease remit to billing"), F.col("o_custkey").cast("string"), F.lit("@example.com or call (555) 123-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.lit("."),
    )
    return joined.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


INVOICES_SQL = """
SELECT o_orderkey AS doc_id,
  'INVOICE' || chr(10) || 'Invoice Number: INV-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') ||
  chr(10) || 'Invoice Date: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'Due Date: ' || strftime(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY, '%Y-%m-%d') ||
  chr(10) || 'Bill To: ' || coalesce(c_name, 'nobody') || chr(10) || 'Line items: ' || CAST(coalesce(n, 0) AS VARCHAR) ||
  chr(10) || 'Subtotal: $' || (net // 100) || '.' || lpad(CAST(net % 100 AS VARCHAR), 2, '0') ||
  chr(10) || 'Tax: $' || ((net * 8 // 100) // 100) || '.' || lpad(CAST((net * 8 // 100) % 100 AS VARCHAR), 2, '0') ||
  chr(10) || 'Total: $' || ((net + net * 8 // 100) // 100) || '.' || lpad(CAST((net + net * 8 // 100) % 100 AS VARCHAR), 2, '0') ||
  chr(10) || 'Please remit to billing' || o_custkey || '@example.com or call (555) 123-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '.' AS text
FROM (
  SELECT o.*, c.c_name, l.n, CAST(coalesce(l.net, 0) AS BIGINT) AS net
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS net, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
)
"""

_LETTER = (
    "Dear Dr. Jane Miller,\n\nRe: case number: REF-{k}\nI am writing on behalf of {n} Trading GmbH about the shipment of January {d}, 2024.\n"
    "Effective date: {d} March 2023\nWebsite: https://www.example.com/{k}\nAddress: {k} Main Street, Suite {d}\nThe amount due is USD 1,{h}.50, call 1-800-555-{q}.\n\nSincerely,\nMr. John Smith\n"
)


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text, one per nation."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    out = F.lit(_LETTER)
    for mark, value in (
        ("{k}", F.concat(F.lit("2024"), k.cast("string"))), ("{n}", F.initcap("n_name")), ("{d}", (k % 28 + 1).cast("string")),
        ("{h}", (k + 100).cast("string")), ("{q}", (k + 1000).cast("string"))
    ):
        out = F.replace(out, F.lit(mark), value)
    return n.select(k.cast("bigint").alias("doc_id"), out.alias("text"))


LETTERS_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, " + "replace(" * 5 + "'" + _LETTER.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" + (
    ", '{k}', '2024' || n_nationkey), '{n}', array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')), '{d}', CAST(n_nationkey % 28 + 1 AS VARCHAR)), '{h}', CAST(n_nationkey + 100 AS VARCHAR)), '{q}', CAST(n_nationkey + 1000 AS VARCHAR)) AS text FROM nation"
)


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices, and letters with negative ids, over all cores: what reads texts takes far longer than the joins that make them."""
    texts = invoices(spark, sf_dir).unionByName(letters(spark, sf_dir).withColumn("doc_id", -F.col("doc_id") - 1))
    return texts.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id")


RENDERED_SQL = f"SELECT * FROM ({INVOICES_SQL}) UNION ALL SELECT -doc_id - 1, text FROM ({LETTERS_SQL})"
