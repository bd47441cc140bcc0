"""Job inputs derived from the given tables.

The expressions are plain SQL that Spark and DuckDB read alike, so both sides start from the same
rows.  Messages, raw answers and shipments grow with orders and lineitem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelflow.plans.lanes import shipments
from parcelflow.sources.spread import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Tables whose texts, or texts made from them, go through long chains of functions.
SPREAD = ("documents", "conversations", "orders")

TEN = "CAST(1000000000 + o_orderkey AS STRING)"
EIGHT = "CAST(10000000 + o_orderkey AS STRING)"


COUNTRIES = "AE SA KW QA JO DE FR IT ES NL SE PL US CA BR CN IN JP GB ZA AU MX KE EG TR".split()
SERVICES = ["express", "standard", "economy"]


def _cc(key: str) -> str:
    """Country code of a nation key: GCC, EU and other countries."""
    return "CASE " + " ".join(f"WHEN {key} = {i} THEN '{c}'" for i, c in enumerate(COUNTRIES)) + " END"


MESSAGE_TEXTS = [
    "'Track my order'",
    f"'Track A' || {TEN} || '5 with Shipping_A please'",
    f"'Where is my parcel 1Z-999-AA1-' || {EIGHT} || '-84 with ShippingB?'",
    f"'status for ' || substr({TEN}, 1, 3) || ' ' || substr({TEN}, 4, 3) || ' ' || substr({TEN}, 7, 4)",
    "'Give me the DHL tracking link now'",
    f"'Customs hold received, invoice INV-' || {EIGHT} || '. What documents are needed?'",
    f"'Package marked delivered but I did not get it. Order ' || {TEN}",
    f"'When will it arrive ' || {_cc('o_custkey % 25')} || ' to ' || {_cc('o_orderkey % 25')} || "
    "' express? ETA please'",
    "'How much to ship 1kg from JO to AE express?'",
    f"'Please change the address on waybill no: CXX-' || {EIGHT} || ' to suite 5'",
    "'how long is economy delivery time JO to DE, and the price?'",
    f"'My invoice INV' || {EIGHT} || ' and date ' || CAST(CAST(o_orderdate AS DATE) AS STRING)",
    f"'IDs: AB12CD34 and ' || {TEN} || 'XYZ with shippingc, scan status and eta'",
    "'hello, a general question about labels'",
    f"'PO123456 lost? track ' || {TEN} || ' and ' || {TEN} || ', also AB1-' || {EIGHT}",
    "'website url for tracking information, priority ' || o_orderpriority",
]
RAW_ANSWERS = [
    "'1) Check the latest scan.' || chr(10) || '2. Confirm the address ·'",
    "'Thanks for reaching out, glad to help' || chr(10) || '- See www.carrier.com/track now.' || "
    "chr(10) || '- Call us. .'",
    "'Your parcel is on its way. It left the hub! Is anybody home? We will try again. DM us.'",
    "'**Please** share your tracking number' || chr(10) || '- Send the waybill ID…' || chr(10) || "
    "'- I can''t share links' || chr(10) || '- Wait' || chr(10) || '- Retry' || chr(10) || '- Stop'",
    "'Visit https://track.example.org/x?id=1 or ask @carrier_help #now'",
    "''",
    f"'Order ' || {TEN} || ' is with Shipping_A.' || chr(10) || chr(10) || 'Today date: 1 May'",
    "'~~Customs~~ need an invoice' || chr(10) || '3) proof of payment -' || chr(10) || 'example.io'",
]


SERVICE = (
    "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Express' "
    "WHEN o_orderpriority = '5-LOW' THEN 'economy' "
    "WHEN o_orderpriority = '3-MEDIUM' THEN 'standard' ELSE 'unspecified' END"
)
MEASURES = [
    "CAST(p_size AS DOUBLE) / 10 AS weight_kg",
    "CASE WHEN l_returnflag <> 'R' THEN CAST(p_size AS DOUBLE) END AS l_cm",
    "CAST(l_quantity AS DOUBLE) AS w_cm",
    "CAST(30 AS DOUBLE) AS h_cm",
]


def _pick(options: list[str]) -> str:
    n = len(options)
    cases = " ".join(f"WHEN o_orderkey % {n} = {i} THEN {e}" for i, e in enumerate(options))
    return f"CASE {cases} END"


SQL = {
    "messages": f"""
        SELECT o_orderkey AS msg_id, o_custkey AS conv_id, o_orderkey AS turn,
               {_pick(MESSAGE_TEXTS)} AS text,
               CASE WHEN o_orderkey % 7 = 0 THEN 'TRK' || {TEN} END AS tracking,
               CASE WHEN o_orderkey % 11 = 0 THEN 'Shipping_C' END AS carrier
        FROM orders""",
    "raw_answers": f"""
        SELECT o_orderkey AS msg_id, {_pick(MESSAGE_TEXTS)} AS user_msg,
               CASE WHEN o_orderkey % 7 = 0 THEN 'TRK' || {TEN} END AS tracking,
               {_pick(RAW_ANSWERS[1:] + RAW_ANSWERS[:1] + ["o_orderpriority"])} AS raw
        FROM orders""",
    "tweets": """
        SELECT CAST(conv_id * 1000000 + turn AS STRING) AS tweet_id,
               CASE WHEN role = 'user' THEN 'True' ELSE 'False' END AS inbound,
               text,
               CASE WHEN role = 'user'
                    THEN CAST(conv_id * 1000000 + turn + 1 AS STRING) || '.0' END
                 AS response_tweet_id
        FROM conversations""",
    # The same with customers' ids missing in some conversations and repeated in others.
    "repeated_tweets": """
        SELECT CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN NULL
                    WHEN role = 'user' AND conv_id % 3 = 1 THEN CAST(turn AS STRING)
                    ELSE CAST(conv_id * 1000000 + turn AS STRING) END AS tweet_id,
               CASE WHEN role = 'user' THEN 'True' ELSE 'False' END AS inbound,
               text,
               CASE WHEN role = 'user'
                    THEN CAST(conv_id * 1000000 + turn + 1 AS STRING) || '.0' END
                 AS response_tweet_id
        FROM conversations""",
    # Every turn names the next one.  Some conversations end in a turn that is not there, some begin again; some
    # turns are answered twice.
    "threaded_tweets": """
        SELECT CAST(conv_id * 1000 + turn AS STRING) AS tweet_id,
               CASE WHEN role = 'user' THEN 'True' ELSE 'False' END AS inbound,
               text,
               CASE WHEN conv_id % 7 = 3 AND turn = n - 1 THEN CAST(conv_id * 1000 AS STRING) || '.0'
                    WHEN conv_id % 7 = 5 AND turn = 0
                    THEN CAST(conv_id * 1000 + 1 AS STRING) || ',' || CAST(conv_id * 1000 + 2 AS STRING)
                    WHEN conv_id % 7 = 5 AND turn = 1 THEN NULL
                    ELSE CAST(conv_id * 1000 + turn + 1 AS STRING) || '.0' END AS response_tweet_id
        FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) AS counted""",
    "kb_markdown": """
        SELECT 'file' || CAST(doc_id AS STRING) || '.md' AS source,
               '# File ' || CAST(doc_id AS STRING) || chr(10) ||
               replace(replace(replace(text, 'e. ', 'e.' || chr(10) || '## '),
                               'n. ', 'n.' || chr(10) || '### Q: '), 's. ', 's.' || chr(10) || chr(10)) AS text
        FROM documents WHERE text IS NOT NULL""",
    "instructions": f"""
        SELECT o_orderkey, {_pick(MESSAGE_TEXTS)} AS instruction, {_pick(RAW_ANSWERS)} AS response
        FROM orders""",
    "chunks": """
        SELECT 'kb' || CAST(label AS STRING) || '.md' AS source, CAST(vec_id AS STRING) AS chunk_id,
               'handbook entry ' || CAST(vec_id AS STRING) AS text,
               CASE WHEN label % 4 = 0 THEN 'Shipping_A' WHEN label % 4 = 1 THEN 'Shipping_B' END
                 AS carrier,
               embedding AS vec
        FROM embeddings""",
    "kb_files": """
        SELECT CASE WHEN doc_id % 5 = 0 THEN 'README.md'
                    WHEN doc_id % 5 = 1 THEN 'Company_A_' || CAST(doc_id AS STRING) || '.md'
                    WHEN doc_id % 5 = 2 THEN 'shipping_b_company_c_' || CAST(doc_id AS STRING) || '.md'
                    WHEN doc_id % 5 = 3 THEN 'company_c_' || CAST(doc_id AS STRING) || '.md'
                    ELSE source || '_' || CAST(doc_id AS STRING) || '.md' END AS source,
               text
        FROM documents""",
    "lane_counts": f"""
        SELECT {_cc('s_nationkey')} AS origin_cc, {_cc('c_nationkey')} AS dest_cc,
               {SERVICE} AS service, count(*) AS shipments
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
          JOIN customer ON o_custkey = c_custkey
        GROUP BY 1, 2, 3""",
    "weighed_lanes": f"""
        SELECT {_cc('s_nationkey')} AS origin_cc, {_cc('c_nationkey')} AS dest_cc,
               {SERVICE} AS service, {", ".join(MEASURES)}, count(*) AS shipments
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
          JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
        GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "line_weights": """
        SELECT l_orderkey, l_linenumber, CAST(p_size AS DOUBLE) / 10 AS weight_kg,
               CASE WHEN l_returnflag <> 'R' THEN CAST(p_size AS DOUBLE) END AS l_cm,
               l_quantity AS w_cm, l_discount * 100 AS h_cm
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in SPREAD else rows


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input; the tables it names are read under views of their own."""
    sql = SQL[name]
    for t in TABLES:
        if f" {t}" in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def lanes(spark: SparkSession, sf_dir: str, weighed: bool = False) -> DataFrame:
    """One row per order line under the names of the lane jobs."""
    lines, orders, customers, suppliers = (
        table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier")
    )
    parts = table(spark, sf_dir, "part") if weighed else None
    measures = ["l_quantity", "l_returnflag"] if weighed else []
    keys = ["l_orderkey", "l_suppkey", *(["l_partkey"] if weighed else [])]
    rows = shipments(lines.select(*keys, *measures), orders, customers, suppliers, parts)
    return rows.selectExpr(
        f"{_cc('s_nationkey')} AS origin_cc", f"{_cc('c_nationkey')} AS dest_cc",
        f"{SERVICE} AS service", *(MEASURES if weighed else []),
    )


def with_message_vectors(spark: SparkSession, sf_dir: str, messages: DataFrame) -> DataFrame:
    """Give each message the vector of one embedding, by conversation."""
    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding AS vec")
    n = vectors.count()
    return messages.join(vectors, messages["conv_id"] % n == vectors["vec_id"], "left").drop("vec_id")


def cte(*names: str) -> str:
    """WITH clause for reference SQL."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
