"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from replyforge.functions.text import WHITESPACE
from replyforge.plans.fixtures import Fixtures, oracle_views
from replyforge.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the fixtures, with its checking SQL where there is one."""

    def register(build: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(Fixtures(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def over(views: str, *ctes: str) -> str:
    """``WITH`` list of the named derived views and further common tables."""
    head = oracle_views(*views.split()) if views else "WITH " + ctes[0]
    rest = ctes if views else ctes[1:]
    return ", ".join([head, *rest]) + " "


# --- pieces of checking SQL -----------------------------------------------------------


def sql_strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def sql_nullish(x: str) -> str:
    s = sql_strip(x)
    return f"CASE WHEN {s} <> '' AND lower({s}) <> 'nan' THEN {s} END"


def sql_words(kind: str) -> str:
    words = {
        "loan": "('DISBURSED','CLOSED','UNDER_REVIEW','REJECTED','EXPIRED')",
        "repay": "('REGULAR','DELAYED_1','DELAYED_3','WRITTEN_OFF')",
    }[kind]
    # The later value of the list counts: repayment column before loan column, lr only when both are missing.
    return (
        f"lower(coalesce(CASE WHEN rs IN {words} THEN rs WHEN ls IN {words} THEN ls "
        f"WHEN ls IS NULL AND rs IS NULL AND lr IN {words} THEN lr END, ''))"
    )


# fx_tickets with cleaned values, both status words, the status and the raw category in lower case
CLASSIFIED = (
    f"cleaned AS (SELECT *, {sql_nullish('data_from')} AS im, {sql_nullish('loan_status')} AS ls, "
    f"{sql_nullish('repayment_status')} AS rs, {sql_nullish('lr_status')} AS lr FROM fx_tickets)",
    f"worded AS (SELECT *, {sql_words('loan')} AS loan, {sql_words('repay')} AS repay, "
    "coalesce(ls, rs, lr) IS NULL AS no_status FROM cleaned)",
    """keyed AS (SELECT *, lower(replace(im, '+', '_')) || CASE
          WHEN no_status THEN 'nostatus'
          WHEN im IN ('IM', 'IM+') AND loan = '' THEN 'nostatus'
          WHEN loan = '' THEN '_nostatus'
          WHEN im IN ('IM', 'IM+') AND loan = 'under_review' THEN 'underreview'
          WHEN im IN ('IM', 'IM+') AND loan IN ('rejected', 'expired', 'closed') THEN loan
          ELSE loan || repay END AS status_key FROM worded)""",
    f"""classified AS (SELECT ticket, alt_ticket, src_order, data_from, category_raw,
          regexp_replace(CASE WHEN im IS NOT NULL THEN status_key ELSE coalesce({sql_strip('lr_status')}, 'nan') END,
                         '_[0-9]+$', '') AS status,
          coalesce(m.collection, lower(category_raw), 'nan') AS category
        FROM keyed LEFT JOIN fx_category_map m ON m.raw = lower(category_raw))""",
)

# every email with what its ticket says
RESOLVED = (
    *CLASSIFIED,
    """resolved AS (SELECT e.*, coalesce(d.status, a.status, 'not_found') AS status,
          coalesce(d.category, a.category, 'not_found') AS category,
          CASE WHEN d.ticket IS NOT NULL THEN 'direct' WHEN a.ticket IS NOT NULL THEN 'alternative' ELSE 'none' END AS matched_by
        FROM fx_emails e LEFT JOIN classified d ON d.ticket = e.ticket LEFT JOIN classified a ON a.alt_ticket = e.ticket)""",
    """named AS (SELECT r.* REPLACE (CASE WHEN status = 'im_closed' THEN 'imclosed' ELSE status END AS status),
          coalesce(m.collection, regexp_replace(category, '[^a-zA-Z0-9_]', '_', 'g')) AS collection
        FROM resolved r LEFT JOIN fx_category_map m ON m.raw = regexp_replace(category, '[^a-zA-Z0-9_]', '_', 'g'))""",
)


def sql_query_text(subject: str, body: str) -> str:
    return f"nullif(concat_ws(' ', nullif({sql_strip(subject)}, ''), nullif({sql_strip(body)}, '')), '')"


def sql_embedding(name: str, source: str, key: str, text: str) -> tuple[str, ...]:
    """Common tables: ``name`` (key, bucket, w) with the hashed single-precision unit vector of every text."""
    return (
        f"{name}_words AS (SELECT {key}, unnest(string_split_regex(lower({text}), '[^a-z0-9]+')) AS word FROM {source})",
        f"{name}_counts AS (SELECT {key}, ('0x' || substr(md5(word), 1, 8))::BIGINT % 384 AS bucket, count(*) AS c "
        f"FROM {name}_words WHERE word <> '' GROUP BY ALL)",
        f"{name} AS (SELECT {key}, bucket, (c / sqrt(sum(c * c) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS w "
        f"FROM {name}_counts)",
    )


KB_TEXT = "coalesce(subject, '') || ' ' || coalesce(email_body, '')"
KB_EMBEDDED = sql_embedding("kb_vec", "fx_kb", "kb_id", KB_TEXT)


def sql_hits(queries: str, text: str, k: int) -> tuple[str, ...]:
    """Common table ``hits``: the ``k`` best rows of each row of ``queries`` (src_order, collection)."""
    return (
        *sql_embedding("q_vec", queries, "src_order", text),
        "q_len AS (SELECT src_order, sqrt(sum(w * w)) AS n FROM q_vec GROUP BY ALL)",
        "kb_len AS (SELECT kb_id, sqrt(sum(w * w)) AS n FROM kb_vec GROUP BY ALL)",
        f"""dots AS (SELECT q.src_order, k.kb_id, sum(v.w * x.w) AS d
             FROM {queries} q JOIN q_vec v ON v.src_order = q.src_order
             JOIN fx_kb k ON k.collection = q.collection
             JOIN kb_vec x ON x.kb_id = k.kb_id AND x.bucket = v.bucket GROUP BY ALL)""",
        f"""scored AS (SELECT q.src_order, q.collection, k.kb_id,
               round(coalesce(d.d / (ql.n * kl.n), 0.0), 6) AS score
             FROM {queries} q JOIN fx_kb k ON k.collection = q.collection
             LEFT JOIN dots d ON d.src_order = q.src_order AND d.kb_id = k.kb_id
             LEFT JOIN q_len ql ON ql.src_order = q.src_order LEFT JOIN kb_len kl ON kl.kb_id = k.kb_id)""",
        f"""hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (
               PARTITION BY src_order ORDER BY score DESC, kb_id) AS INT) AS rank FROM scored) t WHERE rank <= {k})""",
    )
