"""The engine's operators over the star-schema tables, as named queries with the DuckDB SQL that must give the same rows.

``orders``, ``customer`` and ``part`` stand for tables of typed keys. ``events`` stands for a change log: event_id + 1 is the
lsn, user_id the primary key, props the document; a signup inserts, an error deletes, the rest update. Ten events in a row
form a transaction, which a purchase at its end commits and an error aborts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Index
from .functions import documents as D
from .functions import predicates as P
from .functions.crypto import decrypt, encrypt
from .operators.locks import deadlocked, victims
from .operators.relational import combined, grouped, joined, page
from .plans import recovery as R
from .plans import versions as V
from .types import DataType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scans: each comparison on each key type.

_SCANS = {
    "int": ("orders", "o_orderkey", 5000, 9000, ["o_orderkey", "o_custkey", "o_totalprice"]),
    "float": ("lineitem", "l_quantity", 18.0, 40.0, ["l_orderkey", "l_linenumber", "l_quantity"]),
    "varchar": ("orders", "o_orderpriority", "2-HIGH", "4-NOT SPECIFIED", ["o_orderkey", "o_orderpriority"]),
    "date": ("orders", "o_orderdate", dt.datetime(1996, 3, 1), dt.datetime(1997, 12, 31), ["o_orderkey", "o_orderdate"]),
    "bool": ("orders", "o_finished", False, True, ["o_orderkey", "o_finished"]),
}
_COMPARED = {"eq": "=", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<=", "between": "between"}


def _sql(value: object) -> str:
    return f"TIMESTAMP '{value}'" if isinstance(value, dt.datetime) else repr(value).upper() if isinstance(value, bool) else repr(value)


def _scan(kind: str, operator: str):
    name, key, low, high, columns = _SCANS[kind]
    if kind == "bool" and operator in ("<", "="):
        low = True  # nothing is below false
    condition = P.Condition(operator, low, high if operator == "between" else None).check(DataType.of(low))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, name)
        if kind == "bool":
            rows = rows.withColumn("o_finished", F.col("o_orderstatus") == "F")
        return rows.where(condition.column(F.col(key))).select(*columns)

    shown = [f"{c} = 'F' AS o_finished" if c == "o_orderstatus" else c for c in columns]
    shown = ["(o_orderstatus = 'F') AS o_finished" if c == "o_finished" else c for c in shown]
    left = "(o_orderstatus = 'F')" if kind == "bool" else key
    test = f"{left} BETWEEN {_sql(low)} AND {_sql(high)}" if operator == "between" else f"{left} {operator.replace('!=', '<>')} {_sql(low)}"
    return run, f"SELECT {', '.join(shown)} FROM {name} WHERE {test}"


for _kind in _SCANS:
    for _short, _operator in _COMPARED.items():
        QUERIES[f"scan_{_short}_{_kind}"], ORACLES[f"scan_{_short}_{_kind}"] = _scan(_kind, _operator)


@query("scan_all", "SELECT p_partkey, p_name FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey")


@query("scan_range", "SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 100 AND 900")
def _(spark, d):
    return table(spark, d, "customer").where(P.between(100, 900).column(F.col("c_custkey"))).select("c_custkey", "c_name").orderBy("c_custkey")


@query("scan_unknown_op", "SELECT c_custkey FROM customer WHERE false")
def _(spark, d):
    return table(spark, d, "customer").where(P.Condition("~", 1).column(F.col("c_custkey"))).select("c_custkey")


@query("scan_between_reversed", "SELECT c_custkey FROM customer WHERE c_custkey BETWEEN 900 AND 100")
def _(spark, d):
    return table(spark, d, "customer").where(P.between(900, 100).column(F.col("c_custkey"))).select("c_custkey")


@query("scan_topk", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 25")
def _(spark, d):
    return page(table(spark, d, "orders").where(P.greater_than(700).column(F.col("o_orderkey"))).select("o_orderkey", "o_totalprice"), ["o_orderkey"], 25)


@query("scan_two_keys", "SELECT o_orderkey FROM orders WHERE (o_totalprice >= 200000.0 AND o_orderpriority = '1-URGENT') OR o_orderkey < 50")
def _(spark, d):
    c = P.both((F.col("o_totalprice"), P.greater_or_equal(200_000.0)), (F.col("o_orderpriority"), P.equal("1-URGENT")))
    return table(spark, d, "orders").where(c | P.either((F.col("o_orderkey"), P.less_than(50)))).select("o_orderkey")


@query("get_hit", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77")
def _(spark, d):
    return table(spark, d, "customer").where(P.equal(77).column(F.col("c_custkey"))).select("c_custkey", "c_name", "c_acctbal")


@query("get_miss", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = -1")
def _(spark, d):
    return table(spark, d, "customer").where(P.equal(-1).column(F.col("c_custkey"))).select("c_custkey", "c_name")


@query("get_secondary", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    return table(spark, d, "customer").where(P.equal("BUILDING").column(F.col("c_mktsegment"))).select("c_custkey", "c_mktsegment")


@query("index_unique_lastwriter", "SELECT c_nationkey, max(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey")
def _(spark, d):
    return V.last_writers(table(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", ["c_custkey"])


# Versions: events as a change log.

_LOG = """log AS (SELECT event_id + 1 AS lsn, user_id, props, value, ts, event_id // 10 AS tx_id, event_type,
  CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS type FROM events)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("lsn"), "user_id", "props", "value", "ts", F.floor(F.col("event_id") / 10).alias("tx_id"), "event_type", kind.alias("type"))


def _asof_sql(bound: str) -> str:
    return f"""WITH {_LOG}, v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS n FROM log WHERE {bound})
SELECT user_id, lsn, props FROM v WHERE n = 1 AND type <> 'DELETE'"""


def _asof(bound: str):
    return lambda spark, d: V.latest(log(spark, d), ["user_id"], ["lsn"], F.expr(bound), ["lsn", "props"], "type")


for _name, _bound in {"early": "lsn <= 500", "mid": "lsn <= 5001", "latest": "lsn > 0"}.items():
    QUERIES[f"snap_asof_{_name}"], ORACLES[f"snap_asof_{_name}"] = _asof(_bound), _asof_sql(_bound)


@query("snap_intervals", f"WITH {_LOG} SELECT user_id, lsn AS valid_from, lead(lsn) OVER (PARTITION BY user_id ORDER BY lsn) AS valid_to, type FROM log")
def _(spark, d):
    return V.intervals(log(spark, d), ["user_id"], ["lsn"]).select("user_id", "valid_from", "valid_to", "type")


@query("snap_visible_by_interval", f"""WITH {_LOG}, s AS (SELECT *, lead(lsn) OVER (PARTITION BY user_id ORDER BY lsn) AS valid_to FROM log)
SELECT user_id, lsn FROM s WHERE lsn <= 5001 AND (valid_to IS NULL OR valid_to > 5001) AND type <> 'DELETE'""")
def _(spark, d):
    return V.visible(V.intervals(log(spark, d), ["user_id"], ["lsn"]), 5001, "type").select("user_id", "lsn")


@query("snap_rc_vs_rr", f"""WITH {_LOG}, r AS (SELECT user_id, max(lsn) FILTER (lsn <= 3000) AS rr_lsn, max(lsn) AS rc_lsn FROM log GROUP BY user_id)
SELECT user_id, rr_lsn, rc_lsn FROM r WHERE rr_lsn IS DISTINCT FROM rc_lsn""")
def _(spark, d):
    both = log(spark, d).groupBy("user_id").agg(F.max(F.when(F.col("lsn") <= 3000, F.col("lsn"))).alias("rr_lsn"), F.max("lsn").alias("rc_lsn"))
    return both.where(~F.col("rr_lsn").eqNullSafe(F.col("rc_lsn")))


@query("snap_get_pk", f"{_asof_sql('lsn <= 5001')} AND user_id = 17")
def _(spark, d):
    return V.latest(log(spark, d), ["user_id"], ["lsn"], F.expr("lsn <= 5001"), ["lsn", "props"], "type", below=P.equal(17).column(F.col("user_id")))


@query("snap_filter_after_version", f"{_asof_sql('lsn <= 5001')} AND value > 50.0")
def _(spark, d):
    rows = V.latest(log(spark, d), ["user_id"], ["lsn"], F.expr("lsn <= 5001"), ["lsn", "props", "value"], "type")
    return rows.where(P.greater_than(50.0).column(F.col("value"))).select("user_id", "lsn", "props")


# Writes.

@query("dml_insert_only_dups", f"WITH {_LOG} SELECT i.lsn, i.user_id FROM log i WHERE i.type = 'INSERT' AND EXISTS (SELECT 1 FROM log o WHERE o.user_id = i.user_id AND o.lsn < i.lsn)")
def _(spark, d):
    rows = log(spark, d)
    first = rows.groupBy("user_id").agg(F.min("lsn").alias("first_lsn"))
    return rows.where("type = 'INSERT'").select("lsn", "user_id").join(first, "user_id").where("lsn > first_lsn").select("lsn", "user_id")


@query("dml_upsert_latest", """WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM b WHERE n = 1""")
def _(spark, d):
    return V.last_writers(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", ["o_orderkey"])


@query("dml_delete_tombstones", f"WITH {_LOG}, v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS n FROM log) SELECT user_id, lsn FROM v WHERE n = 1 AND type = 'DELETE'")
def _(spark, d):
    newest = log(spark, d).groupBy("user_id").agg(F.max_by(F.struct("lsn", "type"), "lsn").alias("v"))
    return newest.where("v.type = 'DELETE'").select("user_id", F.col("v.lsn").alias("lsn"))


@query("dml_delete_where", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 100000.0)")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    gone = rows.where(P.less_than(100_000.0).column(F.col("o_totalprice"))).select("o_orderkey", F.lit("DELETE").alias("_type"), "o_totalprice")
    return V.overlay(rows, gone, ["o_orderkey"]).select("o_orderkey")


@query("dml_reject_types", "SELECT event_id, 'DECIMAL' AS found FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, 'STRING' FROM events WHERE event_id % 3 = 2")
def _(spark, d):
    shape = F.col("event_id") % 3
    doc = F.when(shape == 0, F.format_string('{"id":%d}', "event_id")).when(shape == 1, F.format_string('{"id":%d.5}', "event_id")).otherwise(F.format_string('{"id":"%d"}', "event_id"))
    rows = table(spark, d, "events").select("event_id", doc.alias("doc"))
    bad = rows.where(D.key_of(F.col("doc"), Index("id", DataType.INT, True)).isNull())
    return bad.select("event_id", F.regexp_replace(D.field_type(F.col("doc"), "id"), r"\(.*", "").alias("found"))


@query("dml_missing_field", "SELECT event_id FROM events WHERE event_id % 4 = 0")
def _(spark, d):
    doc = F.when(F.col("event_id") % 4 == 0, F.lit('{"email":"no-id"}')).otherwise(F.format_string('{"id":%d}', "event_id"))
    return table(spark, d, "events").select("event_id", doc.alias("doc")).where(~D.has_field(F.col("doc"), "id")).select("event_id")


# Transactions.

_TX = f"""{_LOG}, ends AS (SELECT tx_id, max(lsn) AS last_lsn, arg_max(event_type, lsn) AS last_type FROM log GROUP BY tx_id),
fate AS (SELECT tx_id, last_lsn, CASE last_type WHEN 'purchase' THEN 'COMMITTED' WHEN 'error' THEN 'ABORTED' ELSE 'ACTIVE' END AS status FROM ends)"""


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with a marker after each transaction's last change (lsn doubled, so that markers fit between)."""
    rows = log(spark, sf_dir).select((F.col("lsn") * 2).alias("lsn"), "tx_id", "type", F.lit("users").alias("table"), "user_id", "props", F.col("event_type"))
    ends = rows.groupBy("tx_id").agg(F.max("lsn").alias("lsn"), F.max_by("event_type", "lsn").alias("event_type"))
    marks = ends.where("event_type in ('purchase', 'error')").select((F.col("lsn") + 1).alias("lsn"), "tx_id", F.when(F.col("event_type") == "purchase", "COMMIT").otherwise("ABORT").alias("type"), F.lit(None).cast("string").alias("table"), F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("props"), "event_type")
    return rows.unionByName(marks)


@query("tx_commit_visible", f"WITH {_TX}, v AS (SELECT l.*, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS n FROM log l JOIN fate USING (tx_id) WHERE status = 'COMMITTED') SELECT user_id, 2 * lsn AS lsn, props FROM v WHERE n = 1 AND type <> 'DELETE'")
def _(spark, d):
    return R.final_state(wal(spark, d), ["user_id"], ["lsn", "props"])


@query("tx_rollback_hidden", f"WITH {_TX} SELECT l.lsn * 2 AS lsn, l.user_id FROM log l JOIN fate USING (tx_id) WHERE status = 'ABORTED'")
def _(spark, d):
    rows = wal(spark, d)
    return rows.where("table is not null").join(R.transactions(rows).where("status = 'ABORTED'").select("tx_id"), "tx_id", "left_semi").select("lsn", "user_id")


@query("tx_read_own_writes", """SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 15 <> 0 OR c_custkey % 10 = 0""")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    puts = rows.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100).withColumn("_type", F.lit("UPSERT"))
    deletes = rows.where("c_custkey % 15 = 0 and c_custkey % 10 <> 0").withColumn("_type", F.lit("DELETE"))
    return V.overlay(rows, puts.unionByName(deletes), ["c_custkey"])


@query("tx_conflicts", f"""WITH {_LOG}, a AS (SELECT user_id, max(lsn) AS read_lsn FROM log WHERE lsn <= 4000 GROUP BY user_id), b AS (SELECT user_id, max(lsn) AS now_lsn FROM log WHERE lsn <= 4100 GROUP BY user_id)
SELECT user_id, read_lsn, now_lsn FROM b LEFT JOIN a USING (user_id) WHERE read_lsn IS DISTINCT FROM now_lsn""")
def _(spark, d):
    rows = log(spark, d)
    seen = rows.where("lsn <= 4000").groupBy("user_id").agg(F.max("lsn").alias("read_lsn"))
    now = rows.where("lsn <= 4100").groupBy("user_id").agg(F.max("lsn").alias("now_lsn"))
    return now.join(seen, "user_id", "left").where(~F.col("read_lsn").eqNullSafe(F.col("now_lsn"))).select("user_id", "read_lsn", "now_lsn")


# Recovery.

@query("rec_max_lsn", f"WITH {_TX} SELECT greatest((SELECT max(lsn) * 2 FROM log), (SELECT max(last_lsn * 2 + 1) FROM fate WHERE status <> 'ACTIVE')) AS max_lsn")
def _(spark, d):
    return R.max_lsn(wal(spark, d))


@query("rec_checkpoint_lsn", f"WITH {_LOG} SELECT max(lsn) AS checkpoint_lsn FROM log WHERE event_type = 'signup' AND lsn % 7 = 0")
def _(spark, d):
    rows = log(spark, d)
    marks = rows.where("event_type = 'signup' and lsn % 7 = 0").withColumn("type", F.lit("CHECKPOINT"))
    return R.checkpoint_lsn(rows.unionByName(marks))


@query("rec_tx_table", f"WITH {_TX} SELECT tx_id, min(l.lsn) * 2 AS first_lsn, max(last_lsn) * 2 + CASE WHEN max(status) = 'ACTIVE' THEN 0 ELSE 1 END AS last_lsn, max(status) AS status FROM log l JOIN fate USING (tx_id) GROUP BY tx_id")
def _(spark, d):
    return R.transactions(wal(spark, d))


@query("rec_winners", f"WITH {_TX} SELECT tx_id FROM fate WHERE status = 'COMMITTED'")
def _(spark, d):
    return R.winners(wal(spark, d))


@query("rec_losers", f"WITH {_TX} SELECT tx_id FROM fate WHERE status = 'ACTIVE'")
def _(spark, d):
    return R.losers(wal(spark, d))


@query("rec_dirty_indexes", f"WITH {_LOG}, t AS (SELECT lsn, 'id' AS index FROM log UNION ALL SELECT lsn, 'email' FROM log WHERE event_type IN ('signup', 'view')) SELECT 'users' AS table, index, min(lsn) * 2 AS first_lsn FROM t GROUP BY index")
def _(spark, d):
    touched = F.when(F.col("event_type").isin("signup", "view"), F.array(F.lit("id"), F.lit("email"))).otherwise(F.array(F.lit("id")))
    return R.dirty_indexes(wal(spark, d), touched)


@query("rec_redo_set", f"WITH {_TX} SELECT l.lsn * 2 AS lsn, l.user_id FROM log l JOIN fate USING (tx_id) WHERE status = 'COMMITTED' AND l.lsn * 2 >= 4000")
def _(spark, d):
    return R.redo_set(wal(spark, d), 4000).select("lsn", "user_id")


@query("rec_final_state", f"WITH {_TX}, v AS (SELECT l.*, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS n FROM log l JOIN fate USING (tx_id) WHERE status = 'COMMITTED' AND lsn * 2 >= 2000) SELECT user_id, props FROM v WHERE n = 1 AND type <> 'DELETE'")
def _(spark, d):
    return R.final_state(wal(spark, d), ["user_id"], ["props"], 2000, ["users"])


@query("rec_undo_next_lsn", f"WITH {_TX} SELECT tx_id, l.lsn * 2 AS lsn, coalesce(lag(l.lsn * 2) OVER (PARTITION BY tx_id ORDER BY l.lsn), 0) AS undo_next_lsn FROM log l JOIN fate USING (tx_id) WHERE status = 'ACTIVE'")
def _(spark, d):
    return R.undo_tasks(wal(spark, d).withColumn("undone_lsn", F.lit(None).cast("bigint"))).select("tx_id", "lsn", "undo_next_lsn")


@query("rec_undone_lsns", f"WITH {_TX} SELECT tx_id, l.lsn * 2 AS lsn FROM log l JOIN fate USING (tx_id) WHERE status = 'ACTIVE' AND l.lsn % 2 = 0")
def _(spark, d):
    rows = wal(spark, d).withColumn("undone_lsn", F.lit(None).cast("bigint"))
    lost = rows.join(R.losers(rows), "tx_id", "left_semi").where("lsn % 4 = 0")
    clrs = lost.withColumn("undone_lsn", F.col("lsn")).withColumn("lsn", F.col("lsn") + 10_000_000).withColumn("type", F.lit("CLR"))
    return R.undone(rows.unionByName(clrs.select(*rows.columns)))


@query("rec_undo_restores", f"""WITH {_TX}, c AS (SELECT l.* FROM log l JOIN fate USING (tx_id) WHERE status = 'COMMITTED'),
u AS (SELECT l.* FROM log l JOIN fate USING (tx_id) WHERE status = 'ACTIVE'),
p AS (SELECT u.lsn, u.user_id, c.type AS prior_type, c.props AS prior, row_number() OVER (PARTITION BY u.lsn ORDER BY c.lsn DESC) AS n FROM u LEFT JOIN c ON c.user_id = u.user_id AND c.lsn < u.lsn)
SELECT lsn * 2 AS lsn, user_id, coalesce(prior_type <> 'DELETE', false) AS restored, CASE WHEN prior_type <> 'DELETE' THEN prior END AS prior_props FROM p WHERE n = 1""")
def _(spark, d):
    rows = wal(spark, d).withColumn("undone_lsn", F.lit(None).cast("bigint"))
    return R.compensations(rows, ["user_id"], ["props"]).select("lsn", "user_id", "restored", "prior_props")


# Maintenance, locks, documents, encryption.

@query("maint_vacuum_reclaimable", f"WITH {_LOG}, s AS (SELECT *, lead(lsn) OVER (PARTITION BY user_id ORDER BY lsn) AS valid_to FROM log) SELECT user_id, lsn FROM s WHERE type <> 'DELETE' AND valid_to <= 6000")
def _(spark, d):
    return V.reclaimable(log(spark, d), ["user_id"], ["lsn"], 6000, "type").select("user_id", "lsn")


@query("maint_vacuum_survivors", f"WITH {_LOG}, s AS (SELECT *, lead(lsn) OVER (PARTITION BY user_id ORDER BY lsn) AS valid_to FROM log) SELECT user_id, lsn, type FROM s WHERE valid_to IS NULL OR valid_to > 6000")
def _(spark, d):
    return V.survivors(log(spark, d), ["user_id"], ["lsn"], 6000, "type").select("user_id", "lsn", "type")


@query("maint_segment_retention", f"""WITH {_LOG}, g AS (SELECT lsn // 500 AS segment, max(lsn) AS max_lsn FROM log GROUP BY 1)
SELECT segment, max_lsn, max_lsn < 6000 AND row_number() OVER (PARTITION BY max_lsn < 6000 ORDER BY segment DESC) > 2 AS archived FROM g""")
def _(spark, d):
    return R.retained_segments(log(spark, d), 500, 6000, 2)


@query("maint_applied_lsn", f"WITH {_LOG}, t AS (SELECT lsn, 'id' AS index FROM log UNION ALL SELECT lsn, 'email' FROM log WHERE event_type IN ('signup', 'view')) SELECT 'users' AS table, index, max(lsn) * 2 AS applied_lsn FROM t GROUP BY index")
def _(spark, d):
    touched = F.when(F.col("event_type").isin("signup", "view"), F.array(F.lit("id"), F.lit("email"))).otherwise(F.array(F.lit("id")))
    return R.applied_lsns(wal(spark, d), touched)


@query("maint_backup_manifest", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("maint_backup_verify", "SELECT doc_id FROM documents WHERE doc_id % 9 = 0")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    listed = rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    damaged = rows.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    there = damaged.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("found"))
    return listed.join(there, "doc_id", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("found"))).select("doc_id")


# Customers wait in runs of five, whose last waits for the first; of every other run the fourth waits for nobody.
_WAITS = "SELECT DISTINCT c_custkey AS waiter, CASE WHEN c_custkey % 5 = 4 THEN c_custkey - 4 WHEN c_custkey % 5 < 3 OR c_custkey % 10 = 3 THEN c_custkey + 1 ELSE -1 END AS holder FROM customer"
#: Transitive closure: who waits, over others, for itself.
_CYCLES = f"""WITH RECURSIVE w AS ({_WAITS}), reach(a, b) AS (SELECT waiter, holder FROM w UNION SELECT reach.a, w.holder FROM reach JOIN w ON w.waiter = reach.b),
member AS (SELECT a FROM reach WHERE a = b), peers AS (SELECT x.a, y.a AS peer FROM member x JOIN reach r ON r.a = x.a JOIN member y ON y.a = r.b)"""


def waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    holder = F.when(key % 5 == 4, key - 4).when((key % 5 < 3) | (key % 10 == 3), key + 1).otherwise(-1)
    return table(spark, sf_dir, "customer").select(key.alias("waiter"), holder.cast("bigint").alias("holder")).distinct()


@query("lock_deadlock_cycles", f"{_CYCLES} SELECT a AS member, count(*) AS cycle_length FROM peers GROUP BY a")
def _(spark, d):
    return deadlocked(waits(spark, d))


@query("lock_victims", f"{_CYCLES} SELECT DISTINCT max(peer) AS victim, count(*) AS cycle_length FROM peers GROUP BY a")
def _(spark, d):
    return victims(waits(spark, d))


@query("lock_one_long_cycle", "SELECT max(c_custkey) AS victim, count(*) AS cycle_length FROM customer")
def _(spark, d):
    """All customers in one cycle: each waits for the next, the last for the first."""
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("waiter"))
    ends = keys.agg(F.min("waiter").alias("least"), F.max("waiter").alias("most")).first()
    return victims(keys.withColumn("holder", F.when(F.col("waiter") == ends["most"], ends["least"]).otherwise(F.col("waiter") + 1)))


@query("json_extract_key", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", D.key_of(F.col("props"), Index("k", DataType.INT, True)).alias("k"))


@query("json_roundtrip", "SELECT event_id, 'users' AS table, 'id' AS index, user_id AS key, props AS document FROM events")
def _(spark, d):
    key = F.create_map(F.lit("id"), D.key_struct(F.col("user_id"), DataType.INT))
    text = D.entry_to_json(F.lit("users"), F.lit("id"), key, F.col("props"))
    back = D.entry_from_json(text)
    rows = table(spark, d, "events").select("event_id", back.alias("e"))
    return rows.select("event_id", "e.table", "e.index", D.key_from_struct(F.col("e.keys")["id"], DataType.INT).alias("key"), "e.document")


@query("json_compensation", """SELECT event_id // 10 AS tx_id, event_id AS undone_lsn, event_id % 10 AS undone_seq, greatest(event_id - 1, 0) AS undo_next_lsn, 'users' AS table,
'{"id":' || user_id || '}' AS key, event_type <> 'error' AS restored, CASE WHEN event_type <> 'error' THEN props END AS doc FROM events""")
def _(spark, d):
    lsn, kept = F.col("event_id"), F.col("event_type") != "error"
    text = D.compensation_to_json(tx_id=F.floor(lsn / 10), undone_lsn=lsn, undone_seq=lsn % 10, undo_next_lsn=F.greatest(lsn - 1, F.lit(0)), table=F.lit("users"), key=F.to_json(F.struct(F.col("user_id").alias("id"))), restored=kept, doc=F.when(kept, F.col("props")))
    return table(spark, d, "events").select(D.compensation_from_json(text).alias("c")).select("c.*")


@query("json_keys_all_types", "SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderdate, (o_orderstatus = 'F') AS o_finished FROM orders")
def _(spark, d):
    kinds = {"o_orderkey": DataType.INT, "o_totalprice": DataType.FLOAT, "o_orderpriority": DataType.VARCHAR, "o_orderdate": DataType.DATE, "o_finished": DataType.BOOL}
    rows = table(spark, d, "orders").withColumn("o_finished", F.col("o_orderstatus") == "F")
    structs = rows.select(*(D.key_struct(F.col(c), k).alias(c) for c, k in kinds.items()))
    return structs.select(*(D.key_from_struct(F.col(c), k).alias(c) for c, k in kinds.items()))


@query("json_opaque_documents", "SELECT count(*) AS opaque FROM events WHERE event_id % 2 = 1")
def _(spark, d):
    doc = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("user_"), F.col("event_id").cast("string"))).otherwise(F.col("props"))
    return table(spark, d, "events").select(doc.alias("doc")).where(~D.is_json(F.col("doc"))).agg(F.count("*").alias("opaque"))


@query("crypto_roundtrip", "SELECT event_id, props FROM events")
def _(spark, d):
    key, aad = F.lit(bytes(range(32))), F.concat_ws("|", F.lit("events"), F.col("event_id").cast("string"))
    sealed = table(spark, d, "events").select("event_id", encrypt(F.col("props"), key, aad).alias("props"))
    return sealed.select("event_id", decrypt(F.col("props"), key, aad).alias("props"))


# Joins, aggregates, sorting.

_JOIN = "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000.0"


def _join(strategy: str):
    def run(spark, d):
        orders = table(spark, d, "orders").where(P.greater_than(150_000.0).column(F.col("o_totalprice"))).select("o_orderkey", "o_custkey")
        customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
        return joined(orders, customers, F.col("o_custkey") == F.col("c_custkey"), strategy=strategy).select("o_orderkey", "c_name", "c_mktsegment")

    return run


for _strategy in ("auto", "hash", "merge"):
    QUERIES[f"rel_join_{_strategy}"], ORACLES[f"rel_join_{_strategy}"] = _join(_strategy), _JOIN


@query("rel_join_loop", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return joined(nation, region, F.col("n_regionkey") == F.col("r_regionkey"), strategy="loop").select("n_name", "r_name")


@query("rel_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000.0) AS has_large FROM customer")
def _(spark, d):
    customers = table(spark, d, "customer").select("c_custkey")
    large = table(spark, d, "orders").where(P.greater_than(400_000.0).column(F.col("o_totalprice"))).select(F.col("o_custkey").alias("c_custkey"))
    return joined(customers, large, "c_custkey", "left_semi").withColumn("has_large", F.lit(True)).union(joined(customers, large, "c_custkey", "left_anti").withColumn("has_large", F.lit(False)))


@query("rel_agg_segments", "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS total, min(c_acctbal) AS least, max(c_acctbal) AS most, count(DISTINCT c_nationkey) AS nations, round(avg(c_nationkey), 6) AS mean FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    out = grouped(table(spark, d, "customer"), ["c_mktsegment"], n=("count", "*"), total=("sum", "c_nationkey"), least=("min", "c_acctbal"), most=("max", "c_acctbal"), nations=("count_distinct", "c_nationkey"), mean=("avg", "c_nationkey"))
    return out.withColumn("mean", F.round("mean", 6))


@query("rel_agg_lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def _(spark, d):
    rows = table(spark, d, "lineitem").where(P.less_or_equal(dt.datetime(1998, 9, 2)).column(F.col("l_shipdate"))).select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("q"))
    return grouped(rows, ["l_returnflag", "l_linestatus"], n=("count", "*"), quantity=("sum", "q"))


@query("rel_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def _(spark, d):
    return page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 20, 5)


@query("rel_set_operations", """SELECT 'union' AS operation, count(*) AS n FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'except', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT c_custkey FROM customer)""")
def _(spark, d):
    customers, orders = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders")
    buyers = orders.select(F.col("o_custkey").alias("k"))
    made = {"union": combined("union", customers, buyers), "intersect": combined("intersect", customers, buyers), "except": combined("except", orders.select(F.col("o_orderkey").alias("k")), customers)}
    out = None
    for name, df in made.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("operation"), "n")
        out = one if out is None else out.union(one)
    return out


@query("rel_rollup", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def _(spark, d):
    return grouped(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], sets="rollup", n=("count", "*"))


@query("rel_cube", "SELECT o_orderpriority, o_orderstatus, max(o_totalprice) AS most FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def _(spark, d):
    return grouped(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], sets="cube", most=("max", "o_totalprice"))


@query("rel_sql_view", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
def _(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer_rows")
    return spark.sql("SELECT c_nationkey, count(*) AS n FROM customer_rows GROUP BY c_nationkey")
