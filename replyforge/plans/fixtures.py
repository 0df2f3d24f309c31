"""Tickets, emails, knowledge base, fields and templates derived from the given tables.

Each view is ANSI SQL that means the same in Spark and in the checking engine, over
whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyforge.session import spread_small

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# The status columns of the three kinds of sheet; a collection's number picks its kind.
STATUS_FIELDS = {
    0: ["imclosed", "imunderreview", "imdisbursedregular", "imdisburseddelayed", "improcessing", "im_underreview"],
    1: ["imunderreview", "imrejected", "imdisburseddelayed", "imnostatus", "im_underreview", "im__closed"],
    2: ["imclosed", "imrejected", "imdisbursedregular", "imnostatus", "improcessing", "im__closed"],
}
ALL_STATUS_FIELDS = sorted({f for fields in STATUS_FIELDS.values() for f in fields})
BASE_FIELDS = ["id", "embedding", "subject", "email_body"]

_FIELD_ROWS = ", ".join(
    f"({kind}, {i}, '{field}')" for kind, fields in STATUS_FIELDS.items() for i, field in enumerate(BASE_FIELDS + fields)
)
_STATUS_COLUMNS = ", ".join(
    f"CASE WHEN (doc_id + {i}) % 4 = 0 THEN '' ELSE 'Reply {f} ' || CAST(doc_id AS STRING) END AS {f}"
    for i, f in enumerate(ALL_STATUS_FIELDS)
)

FX_SQL = {
    # raw category -> collection; src20..src24 are mapped names without a collection
    "fx_category_map": """
        SELECT 'long_category_name_' || CAST(n_nationkey AS STRING) || '_request_' AS raw,
               'src' || CAST(n_nationkey AS STRING) AS collection
        FROM {nation}""",
    # every pair of product value, loan and repayment status; missing values of each kind
    "fx_tickets": """
        SELECT CAST(o_orderkey AS STRING) AS ticket,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey + 100000000 AS STRING) END AS alt_ticket,
               o_orderkey AS src_order,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'IM' WHEN '2-HIGH' THEN ' IM+ '
                    WHEN '3-MEDIUM' THEN 'IM++' WHEN '5-LOW' THEN ' NaN ' END AS data_from,
               CASE o_orderkey % 6 WHEN 0 THEN 'DISBURSED' WHEN 1 THEN 'CLOSED' WHEN 2 THEN 'UNDER_REVIEW'
                    WHEN 3 THEN 'REJECTED' WHEN 4 THEN 'EXPIRED' END AS loan_status,
               CASE o_orderkey % 5 WHEN 0 THEN 'REGULAR' WHEN 1 THEN 'DELAYED_1' WHEN 2 THEN 'DELAYED_3'
                    WHEN 3 THEN 'WRITTEN_OFF' END AS repayment_status,
               CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'improcessing_12' END AS lr_status,
               CASE WHEN o_custkey % 30 < 25
                    THEN 'Long_Category_Name_' || CAST(o_custkey % 30 AS STRING) || '_Request_'
                    WHEN o_custkey % 30 = 25 THEN 'other_kyc_issues'
                    WHEN o_custkey % 30 = 26 THEN ''
                    WHEN o_custkey % 30 = 27 THEN 'no_such_collection'
                    WHEN o_custkey % 30 = 28 THEN 'predisbursal_loan_query_general_info' END AS category_raw
        FROM {orders}""",
    # user messages; some ids match only the alternative id or nothing, some bodies are blank
    "fx_emails": """
        SELECT CAST(conv_id * 8 + turn + CASE WHEN conv_id % 11 = 0 THEN 100000000 ELSE 0 END AS STRING) AS ticket,
               conv_id * 8 + turn AS src_order,
               CASE WHEN turn % 4 = 2 THEN text ELSE ' Conversation ' || CAST(conv_id AS STRING) END AS subject,
               CASE WHEN turn % 4 = 2 THEN '  ' ELSE text END AS email_body
        FROM {conversations} WHERE role = 'user'""",
    # twenty collections as wide sheets: some bodies missing, a quarter of the status cells blank
    "fx_kb": f"""
        SELECT source AS collection, doc_id AS kb_id,
               lang || ' ' || source || ' Entry ' || CAST(doc_id AS STRING) AS subject,
               CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS email_body,
               {_STATUS_COLUMNS}
        FROM {{documents}}""",
    # field names per collection in schema order
    "fx_fields": f"""
        SELECT c.collection, f.field, f.ordinal
        FROM (SELECT DISTINCT source AS collection, CAST(substring(source, 4, 3) AS INT) % 3 AS kind
              FROM {{documents}}) c
        JOIN (VALUES {_FIELD_ROWS}) AS f(kind, ordinal, field) ON f.kind = c.kind""",
    # the first page of a name is its template; src15..src19 have none
    "fx_templates": """
        SELECT collection, html
        FROM (SELECT 'src' || CAST(page_id % 15 AS STRING) AS collection, html,
                     row_number() OVER (PARTITION BY page_id % 15 ORDER BY page_id) AS rn
              FROM {pages}) t
        WHERE rn = 1""",
    # ready-made vectors, collections by label
    "fx_vectors": """
        SELECT CAST(label AS STRING) AS collection, vec_id AS kb_id, embedding FROM {embeddings}""",
}


class Fixtures:
    """The derived frames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, name: str) -> DataFrame:
        text = FX_SQL[name]
        return self.spark.sql(text, **{t: self.table(t) for t in TABLES if f"{{{t}}}" in text})

    @property
    def category_map(self) -> DataFrame:
        return self._sql("fx_category_map")

    @property
    def tickets(self) -> DataFrame:
        return self._sql("fx_tickets")

    @property
    def emails(self) -> DataFrame:
        return self._sql("fx_emails")

    @property
    def kb(self) -> DataFrame:
        return self._sql("fx_kb")

    @property
    def kb_spread(self) -> DataFrame:
        """For work that is long per row, such as embedding."""
        return spread_small(self.kb.select("collection", "kb_id", "subject", "email_body"), "kb_id")

    @property
    def templates(self) -> DataFrame:
        """First page per name as an aggregate, so a name with very many pages cannot fill a task."""
        name = F.concat(F.lit("src"), (F.col("page_id") % 15).cast("string")).alias("collection")
        return self.table("pages").groupBy(name).agg(F.min_by("html", "page_id").alias("html"))

    @property
    def vectors(self) -> DataFrame:
        return self._sql("fx_vectors")

    @property
    def fields(self) -> DataFrame:
        return self._sql("fx_fields")

    @property
    def kb_rows(self) -> DataFrame:
        """The knowledge base as the engine stores it: status cells of the row's own sheet kind in one map."""
        kind = F.substring("collection", 4, 3).cast("int") % 3
        own = F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, names))) for k, names in STATUS_FIELDS.items()])
        cells = F.map_from_arrays(F.array(*map(F.lit, ALL_STATUS_FIELDS)), F.array(*ALL_STATUS_FIELDS))
        return self.kb.select(
            "collection", "kb_id", "subject", "email_body",
            F.map_filter(cells, lambda name, _: F.array_contains(own, name)).alias("fields"),
        )


def oracle_views(*names: str) -> str:
    """The views as a ``WITH`` list of plain table names."""
    plain = {t: t for t in TABLES}
    return "WITH " + ", ".join(f"{n} AS ({FX_SQL[n].format(**plain)})" for n in names)
