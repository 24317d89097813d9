"""Queries of scalar functions and sources over the test tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F

from tradewinds.functions import scalars as S
from tradewinds.operators import causal as C
from tradewinds.plans.base import read
from tradewinds.shared import shared_dir
from tradewinds.sources import raw as R

QUERIES, ORACLE = {}, {}


def _parts(s, d):
    return read(s, d, "part")


def _delete(s, path):
    try:
        where = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone already
        return


def _load(s, d):
    """All months of the orders into the shared folder, two of them read back."""
    path = f"{shared_dir(s)}/months-{uuid.uuid4().hex}"
    rows = read(s, d, "orders").select("o_orderkey", "o_custkey", F.lit("exp").alias("flow"), F.date_format("o_orderdate", "yyyy-MM").alias("period"))
    R.write_months(rows.repartition("period"), path)
    atexit.register(_delete, s, path)  # results read it lazily
    return R.load(s, path, "exp", ["o_orderkey"], ["1999-01", "1999-02"])


QUERIES |= {
    "scl03_normalize_code": lambda s, d: read(s, d, "orders").select("o_orderkey", S.normalize_code(F.concat(F.lit("00"), F.col("o_orderkey").cast("string"), F.lit("x"))).alias("code")),
    "scl02_description": lambda s, d: _parts(s, d).select("p_partkey", S.description(F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("A-1~")).otherwise(F.lit("")), F.col("p_name"), F.lit(" uno dos tres cuatro cinco"))).alias("words")),
    "src11_dates": lambda s, d: read(s, d, "orders").select("o_orderkey", S.parse_date(F.when(F.col("o_orderkey") % 5 == 0, F.lit("00000000")).when(F.col("o_orderkey") % 7 == 0, F.lit("31022024")).otherwise(F.date_format("o_orderdate", "ddMMyyyy"))).cast("string").alias("day")),
    "src12_amounts": lambda s, d: _parts(s, d).select("p_partkey", S.parse_amount(F.when(F.col("p_partkey") % 5 == 0, F.lit("nan")).when(F.col("p_partkey") % 7 == 0, F.lit("1.5d")).otherwise(F.regexp_replace(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), r"\.", ","))).alias("amount")),
    "src15_log_upsert": lambda s, d: R.upsert_log(*(read(s, d, "orders").where(w).groupBy(F.col("o_orderstatus").alias("kind"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("rows")) for w in ("true", "o_orderkey % 3 = 0"))),
    "src17_load": _load,
    "src19_html_tables": lambda s, d: R.html_tables(read(s, d, "pages")).groupBy("page_id").agg(F.count("*").alias("rows"), F.countDistinct("table").alias("tables")),
    "src20_ports": lambda s, d: R.port_hierarchy(
        read(s, d, "nation").select((F.col("n_regionkey") * 100 + F.col("n_nationkey") + 1).alias("seq"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("country")).otherwise(F.lit("port")).alias("kind"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
        .unionByName(read(s, d, "region").select((F.col("r_regionkey") * 100).alias("seq"), F.lit("continent").alias("kind"), F.lit(None).cast("string").alias("code"), F.col("r_name").alias("name")))),
    "agg33_annex": lambda s, d: C.annex_codes(_parts(s, d).select(F.concat(F.lit("list\n  "), F.format_string("%08d", (F.col("p_partkey") * 7919) % 100000000), F.lit(" text 12345678")).alias("text"))),
    "set04_code_sets": lambda s, d: read(s, d, "lineitem").select("l_partkey").distinct().join(read(s, d, "part").where("p_size > 25").select("p_partkey"), F.expr("l_partkey = p_partkey"), "left_anti"),
}
ORACLE |= {
    "scl03_normalize_code": "select o_orderkey, coalesce(nullif(ltrim(o_orderkey::varchar, '0'), ''), '0') as code from orders",
    "scl02_description": r"""select p_partkey, nullif(array_to_string(list_filter(string_split(regexp_replace(upper(p_name) || ' UNO DOS TRES CUATRO CINCO', '[^A-ZÁÉÍÓÚÑ ]', ' ', 'g'), ' '), lambda w: w <> '')[1:4], ' '), '') as words from part""",
    "src11_dates": "select o_orderkey, case when o_orderkey % 5 = 0 or o_orderkey % 7 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as day from orders",
    "src12_amounts": "select p_partkey, case when p_partkey % 5 = 0 or p_partkey % 7 = 0 then null else round(p_retailprice, 2) end as amount from part",
    "src15_log_upsert": """with a as (select o_orderstatus as kind, year(o_orderdate)::int as year, month(o_orderdate)::int as month, count(*) as p, count(*) filter (o_orderkey % 3 = 0) as n from orders group by 1, 2, 3) select kind, year, month, case when n > 0 then n else p end as rows from a""",
    "src17_load": "select o_orderkey, strftime(o_orderdate, '%Y-%m') as period from orders where o_orderdate >= timestamp '1999-01-01' and o_orderdate < timestamp '1999-03-01'",
    "src20_ports": """select n_nationkey::varchar as code, n_name as gloss, (select arg_max(c.n_name, c.n_nationkey) from nation c where c.n_regionkey = n.n_regionkey and c.n_nationkey % 3 = 0 and c.n_nationkey < n.n_nationkey) as country, r_name as continent from nation n join region on n_regionkey = r_regionkey where n_nationkey % 3 <> 0""",
    "agg33_annex": """with c as (select distinct lpad(((p_partkey * 7919) % 100000000)::varchar, 8, '0') as code from part) select substr(code, 1, 6) as product, count(*) as n_codes, bool_or(code like '%00') as complete from c group by 1""",
    "set04_code_sets": "select distinct l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size > 25)",
}
