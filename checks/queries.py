"""Every operator as a query over whole test tables, with its comparison SQL.

``QUERIES`` maps a name to ``(query, sql)``; ``sql`` is None where plain SQL
cannot express the operator.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import entries as E, sql as S
from veil import Settings, anonymize, preview
from veil.functions import registry
from veil.operators import audit, mapping, sketches, value_types
from veil.operators.detection import detect_pii
from veil.operators.materialize import materialize, scratch_path
from veil.operators.suppression import k_anonymity
from veil.plans.job import anonymize_tables, run_job
from veil.plans.presets import preset
from veil.sources import samples
from veil.sources.tables import list_columns, load_tables, save_tables
from veil.streaming import session_k_anonymity, shuffle_batches, windowed_k_anonymity

SET = Settings(S.SALT, S.KEY)
PARITY = Settings(S.SALT, S.KEY, parity=True)
QUERIES: dict = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def rule(method: str, **options) -> dict:
    return {"method": method, "options": options}


# --- digests, masks, pseudonyms -------------------------------------------------


@query(f"SELECT c_custkey, {S.digest('c_name')} AS c_name FROM customer")
def hash_sha256(spark, d):
    return anonymize(table(spark, d, "customer").select("c_custkey", "c_name"), {"c_name": "hash"}, SET)


@query(f"SELECT c_custkey, md5(c_name || '{S.SALT}') AS c_name FROM customer")
def hash_md5(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name")
    return anonymize(df, {"c_name": rule("hash", algorithm="md5")}, SET)


# The names that nations have in the test tables; their digests come from Python's library.
_SHA512 = ", ".join(f"('NATION_{i}', '{hashlib.sha512(f'NATION_{i}{S.SALT}'.encode()).hexdigest()}')" for i in range(25))


@query(f"""
    SELECT c_custkey, h AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN (VALUES {_SHA512}) AS v(plain, h) ON n_name = plain
""")
def hash_sha512(spark, d):
    return anonymize(_national(spark, d), {"n_name": rule("hash", algorithm="sha512")}, SET)


@query(f"""
    SELECT o_orderkey, {S.digest('cast(o_custkey AS VARCHAR)')} AS o_custkey,
           {S.digest('cast(o_totalprice AS VARCHAR)')} AS o_totalprice,
           {S.digest(S.stamp('o_orderdate'))} AS o_orderdate,
           {S.digest("CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END")} AS o_done,
           {S.digest("cast(cast(o_totalprice AS DECIMAL(38, 1)) AS VARCHAR)")} AS o_scaled
    FROM orders
""")
def hash_types(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
        (F.col("o_orderstatus") == "F").alias("o_done"), F.col("o_totalprice").alias("o_scaled"),
    )
    policy = {c: "hash" for c in ["o_custkey", "o_totalprice", "o_orderdate", "o_done"]}
    return anonymize(df, {**policy, "o_scaled": rule("hash", scale=1)}, SET)


@query("""
    SELECT p_partkey, repeat('*', length(p_name)) AS p_name, repeat('#-', length(p_type)) AS p_type FROM part
""")
def mask_full(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return anonymize(df, {"p_name": "mask", "p_type": rule("mask", mask_char="#-")}, SET)


@query("""
    SELECT c_custkey,
           CASE WHEN length(c_name) <= 2 THEN repeat('x', length(c_name))
                ELSE substr(c_name, 1, 1) || repeat('x', length(c_name) - 2) || right(c_name, 1) END AS c_name,
           CASE WHEN length(c_nationkey::VARCHAR) <= 2 THEN repeat('x', length(c_nationkey::VARCHAR))
                ELSE 'never' END AS c_nationkey
    FROM customer
""")
def mask_edges(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    edges = rule("mask", mask_char="x", preserve_length=False)
    return anonymize(df, {"c_name": edges, "c_nationkey": edges}, SET)


_CUST = "'CUST_' || substr({}, 1, 8)"


@query(f"""
    WITH o AS (SELECT {_CUST.format(S.digest('o_custkey::VARCHAR'))} AS code, o_totalprice FROM orders),
         c AS (SELECT {_CUST.format(S.digest('c_custkey::VARCHAR'))} AS code, c_mktsegment FROM customer)
    SELECT c_mktsegment, count(*) AS orders, count(DISTINCT code) AS customers,
           round(sum(o_totalprice), 2) AS total
    FROM o JOIN c USING (code) GROUP BY c_mktsegment
""")
def pseudonymize_keys(spark, d):
    code = rule("pseudonymize", prefix="CUST")
    o = anonymize(table(spark, d, "orders").select("o_custkey", "o_totalprice"), {"o_custkey": code}, SET)
    c = anonymize(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), {"c_custkey": code}, SET)
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_distinct("c_custkey").alias("customers"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
    )


# --- generalization ---------------------------------------------------------------


@query(f"SELECT p_partkey, {S.binned('p_size', 10)} AS p_size FROM part")
def bin_int(spark, d):
    return anonymize(table(spark, d, "part").select("p_partkey", "p_size"), {"p_size": "generalize_numeric"}, SET)


@query(f"""
    SELECT c_custkey, {S.binned('c_acctbal - 5000', 1000)} AS balance,
           CASE WHEN c_custkey % 9 = 0 THEN {S.REDACTED}
                ELSE {S.binned('c_acctbal', 250)} END AS written
    FROM customer
""")
def bin_double_negative(spark, d):
    df = table(spark, d, "customer").selectExpr(
        "c_custkey", "c_acctbal - 5000 AS balance",
        "CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE cast(c_acctbal AS string) END AS written",
    )
    return anonymize(df, {
        "balance": rule("generalize_numeric", bin_size=1000),
        "written": rule("generalize_numeric", bin_size=250),
    }, SET)


def _dates(spark, d, granularity):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return anonymize(df, {"o_orderdate": rule("generalize_date", granularity=granularity)}, SET)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS o_orderdate FROM orders")
def date_year(spark, d):
    return _dates(spark, d, "year")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS o_orderdate FROM orders")
def date_month(spark, d):
    return _dates(spark, d, "month")


@query("""
    SELECT o_orderkey, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS o_orderdate FROM orders
""")
def date_quarter(spark, d):
    return _dates(spark, d, "quarter")


@query(f"""
    WITH written AS (
        SELECT o_orderkey, CASE o_orderkey % 6
            WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
            WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
            WHEN 4 THEN strftime(o_orderdate, '%Y.%m.%d') ELSE '2023-02-30' END AS s
        FROM orders
    )
    SELECT o_orderkey, coalesce(strftime(try_strptime(s,
        ['%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%Y-%m-%d %H:%M:%S']), '%Y-%m'), {S.REDACTED}) AS s
    FROM written
""")
def date_strings_mixed(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey", """
        CASE o_orderkey % 6
            WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'MM/dd/yyyy')
            WHEN 2 THEN date_format(o_orderdate, 'dd/MM/yyyy')
            WHEN 3 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')
            WHEN 4 THEN date_format(o_orderdate, 'yyyy.MM.dd') ELSE '2023-02-30' END AS s
    """)
    return anonymize(df, {"s": "generalize_date"}, SET)


# --- contact data -----------------------------------------------------------------

# The test tables hold no contact columns; the same SQL derives them on both sides.
MAIL = """
    lower(replace(c_name, '#', '.')) || CASE c_custkey % 7
        WHEN 0 THEN '@gmail.com' WHEN 1 THEN '@mail.example.co.uk' WHEN 2 THEN '@localhost'
        WHEN 3 THEN '@GMAIL.com' WHEN 4 THEN '@a@b.org' WHEN 5 THEN '@' ELSE ' at home' END
"""
_ID10 = "lpad(cast((c_custkey * 7919 + 2000000000) AS string), 10, '0')"
PHONE = f"""
    CASE c_custkey % 7
        WHEN 0 THEN '(' || substr({_ID10}, 1, 3) || ') ' || substr({_ID10}, 4, 3) || '-' || substr({_ID10}, 7, 4)
        WHEN 1 THEN {_ID10} WHEN 2 THEN '+44 ' || {_ID10} || ' ext.12' WHEN 3 THEN substr({_ID10}, 1, 6)
        WHEN 4 THEN '' WHEN 5 THEN {_ID10} || '/' || {_ID10} ELSE {_ID10} || {_ID10} || {_ID10} || {_ID10} END
"""
SSN = f"""
    CASE c_custkey % 4
        WHEN 0 THEN substr({_ID10}, 2, 3) || '-' || substr({_ID10}, 5, 2) || '-' || substr({_ID10}, 7, 4)
        WHEN 1 THEN substr({_ID10}, 2, 9) WHEN 2 THEN 'unknown' ELSE substr({_ID10}, 2, 9) || ' (old)' END
"""


def _email_sql(bare: str, other: str) -> str:
    local, domain = "substr(s, 1, instr(s, '@') - 1)", "substr(s, instr(s, '@') + 1)"
    company = f"'company' || substr({S.digest(domain)}, 1, 6)"
    return f"""
        WITH derived AS (SELECT c_custkey, {MAIL} AS s FROM customer)
        SELECT c_custkey, CASE WHEN instr(s, '@') = 0 THEN {other} ELSE
            'user' || substr({S.digest(local)}, 1, 8) || '@' || CASE
                WHEN {domain} IN ('gmail.com', 'yahoo.com', 'outlook.com') THEN {domain}
                WHEN instr({domain}, '.') > 0
                    THEN {company} || '.' || list_extract(string_split({domain}, '.'), -1)
                ELSE {bare.format(domain=domain, company=company)} END
        END AS s FROM derived
    """


@query(_email_sql("{company}", S.REDACTED))
def email_derived(spark, d):
    df = table(spark, d, "customer").selectExpr("c_custkey", f"{MAIL} AS s")
    return anonymize(df, {"s": "anonymize_email"}, SET)


@query(_email_sql("{domain}", "s"))
def email_parity(spark, d):
    df = table(spark, d, "customer").selectExpr("c_custkey", f"{MAIL} AS s")
    return anonymize(df, {"s": "anonymize_email"}, PARITY)


def _phone_sql(short: str, source: str | None = None) -> str:
    before = "length(regexp_replace(substr(s, 1, i - 1), '[^0-9]', '', 'g'))"
    new = f"cast(try_cast('0x' || substr(h, 2 * {before} + 1, 2) AS INTEGER) % 10 AS VARCHAR)"
    return f"""
        WITH derived AS (SELECT c_custkey, {source or PHONE} AS s FROM customer),
             dug AS (SELECT *, {S.digest('s')} || sha256({S.digest('s')} || '|1') AS h, length(regexp_replace(s, '[^0-9]', '', 'g')) AS n FROM derived)
        SELECT c_custkey, CASE WHEN n < 7 THEN {short}
            ELSE array_to_string(list_transform(string_split(s, ''),
                lambda ch, i: CASE WHEN ch >= '0' AND ch <= '9' THEN {new} ELSE ch END), '') END AS s
        FROM dug
    """


@query(_phone_sql(S.REDACTED))
def phone_derived(spark, d):
    df = table(spark, d, "customer").selectExpr("c_custkey", f"{PHONE} AS s")
    return anonymize(df, {"s": "anonymize_phone"}, SET)


@query(_phone_sql("s"))
def phone_parity(spark, d):
    df = table(spark, d, "customer").selectExpr("c_custkey", f"{PHONE} AS s")
    return anonymize(df, {"s": "anonymize_phone"}, PARITY)


_LONG_PHONE = "'+' || lpad(c_custkey::VARCHAR, 20, '7') || '-' || lpad(c_custkey::VARCHAR, 20, '3')"


@query(_phone_sql(S.REDACTED, _LONG_PHONE))
def phone_long(spark, d):
    """Forty digits, more than one digest has bytes."""
    number = F.concat(F.lit("+"), F.lpad(F.col("c_custkey").cast("string"), 20, "7"), F.lit("-"),
                      F.lpad(F.col("c_custkey").cast("string"), 20, "3"))
    return anonymize(table(spark, d, "customer").select("c_custkey", number.alias("s")), {"s": "anonymize_phone"}, SET)


_CODE = "translate({}, '0123456789abcdef', '8901234567789012')"
_DASHED = "substr({0}, 1, 3) || '-' || substr({0}, 4, 2) || '-' || substr({0}, 6, 4)"


@query(f"""
    WITH derived AS (SELECT c_custkey, {SSN} AS s, lpad(c_custkey::VARCHAR, 9, '0') AS n FROM customer),
         coded AS (SELECT *, {_CODE.format(S.digest('s'))} AS h, {_CODE.format(S.digest('n'))} AS k FROM derived)
    SELECT c_custkey, CASE WHEN regexp_matches(s, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') THEN {_DASHED.format('h')}
                WHEN regexp_matches(s, '^[0-9]{{9}}') THEN substr(h, 1, 9)
                ELSE {_DASHED.format('h')} END AS s,
           substr(k, 1, 9) AS n
    FROM coded
""")
def ssn_derived(spark, d):
    df = table(spark, d, "customer").selectExpr("c_custkey", f"{SSN} AS s", "c_custkey AS n")
    return anonymize(df, {"s": "anonymize_ssn", "n": "anonymize_ssn"}, SET)


# --- noise ------------------------------------------------------------------------


def _rounded(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.round(column, 4))


def _orders_noise(spark, d, **options):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return _rounded(anonymize(df, {"o_totalprice": options}, SET, ["o_orderkey"]), "o_totalprice")


_PRICE_U = S.u("o_totalprice", "o_orderkey")


@query(f"""
    SELECT o_orderkey, round(o_totalprice + {S.laplace(_PRICE_U, 2.0)}, 4) AS o_totalprice FROM orders
""")
def dp_laplace(spark, d):
    return _orders_noise(spark, d, method="differential_privacy", options={"epsilon": 0.5})


@query(f"""
    SELECT o_orderkey, round(o_totalprice + 10 * {S.gaussian('o_totalprice', 'o_orderkey')}, 4) AS o_totalprice
    FROM orders
""")
def dp_gaussian(spark, d):
    return _orders_noise(
        spark, d, method="differential_privacy", options={"epsilon": 0.1, "mechanism": "gaussian"}
    )


@query(f"""
    SELECT p_partkey, cast(trunc(p_size + {S.laplace(S.u('p_size', 'p_partkey'), 1.0)}) AS INTEGER) AS p_size
    FROM part
""")
def dp_int(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_size")
    return anonymize(df, {"p_size": "differential_privacy"}, SET, ["p_partkey"])


@query(f"""
    WITH p AS (SELECT o_orderkey, cast(o_totalprice AS DECIMAL(14, 2)) AS d FROM orders),
         n AS (SELECT o_orderkey, d::DOUBLE + {S.laplace(S.u('d', 'o_orderkey'), 1.0)} AS x FROM p)
    SELECT o_orderkey, round(cast(x AS DECIMAL(30, 10)), 2)::DECIMAL(14, 2)::DOUBLE AS d FROM n
""")
def dp_decimal(spark, d):
    """Noise on decimals is rounded to their places."""
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(14,2)").alias("d"))
    out = anonymize(df, {"d": "differential_privacy"}, SET, ["o_orderkey"])
    return out.withColumn("d", F.col("d").cast("double"))


_BIG_U = S.u("big", "o_orderkey")


@query(f"""
    SELECT o_orderkey, cast(o_orderkey + {2**60} + cast(floor({S.laplace(_BIG_U, 10.0)}) AS BIGINT) AS BIGINT) AS big
    FROM orders
""")
def dp_big_int(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") + 2**60).alias("big"))
    return anonymize(df, {"big": rule("differential_privacy", epsilon=0.1)}, SET, ["o_orderkey"])


@query(f"""
    SELECT o_orderkey, cast(o_orderkey + {2**60} + cast(floor((2 * {_BIG_U} - 1) * 50) AS BIGINT) AS BIGINT) AS big
    FROM orders
""")
def perturb_big_int(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") + 2**60).alias("big"))
    return anonymize(df, {"big": rule("perturb", range=50)}, SET, ["o_orderkey"])


@query(f"""
    SELECT o_orderkey, round(o_totalprice + (2 * {_PRICE_U} - 1) * (abs(o_totalprice) * 0.1::DOUBLE), 4)
        AS o_totalprice FROM orders
""")
def perturb_uniform(spark, d):
    return _orders_noise(spark, d, method="perturb")


@query(f"""
    SELECT o_orderkey, round(o_totalprice + 250 * {S.gaussian('o_totalprice', 'o_orderkey')}, 4) AS o_totalprice
    FROM orders
""")
def perturb_gaussian(spark, d):
    return _orders_noise(spark, d, method="perturb", options={"type": "gaussian", "range": 250})


@query(f"""
    SELECT o_orderkey, round(o_totalprice + (2 * {_PRICE_U} - 1) * 0.05::DOUBLE * o_totalprice, 4) AS o_totalprice
    FROM orders
""")
def perturb_percentage(spark, d):
    return _orders_noise(spark, d, method="perturb", options={"type": "percentage", "percentage": 5})


_BAL_U = S.u("c_acctbal", "c_custkey")


@query(f"""
    SELECT c_custkey, round(abs(c_acctbal + (2 * {_BAL_U} - 1) * 3000), 4) AS c_acctbal,
           cast(trunc(c_nationkey + (2 * {S.u('c_nationkey', 'c_custkey')} - 1) * 5) AS INTEGER) AS c_nationkey
    FROM customer
""")
def perturb_non_negative(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    policy = {"c_acctbal": rule("perturb", range=3000, non_negative=True), "c_nationkey": rule("perturb", range=5)}
    return _rounded(anonymize(df, policy, SET, ["c_custkey"]), "c_acctbal")


# --- substitution -----------------------------------------------------------------

_SEG = ["Retail", "Trade", "Public"]


@query(f"SELECT c_custkey, {S.pick(S.u('c_mktsegment', 'c_custkey'), _SEG)} AS c_mktsegment FROM customer")
def substitute_list(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return anonymize(df, {"c_mktsegment": rule("substitute", list=_SEG)}, SET, ["c_custkey"])


@query(f"SELECT c_custkey, {S.pick(S.u('c_name', 'c_custkey'), E.SUBSTITUTES['names'])} AS c_name FROM customer")
def substitute_type(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name")
    return anonymize(df, {"c_name": rule("substitute", type="names")}, SET, ["c_custkey"])


@query(f"SELECT c_custkey, {S.REDACTED} AS c_mktsegment FROM customer")
def substitute_default(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return anonymize(df, {"c_mktsegment": "substitute"}, SET, ["c_custkey"])


@query(f"""
    SELECT o_orderkey, {S.pick(f"({S.uniform_of(S.digest('o_orderpriority'))})", E.SUBSTITUTES['cities'])}
        AS o_orderpriority FROM orders
""")
def substitute_consistent(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return anonymize(df, {"o_orderpriority": rule("substitute", type="cities", consistent=True)}, SET)


# --- k-anonymity and shuffle ------------------------------------------------------


@query(f"""
    SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_orderdate) >= 5
        THEN {S.stamp('o_orderdate')} ELSE '[SUPPRESSED]' END AS o_orderdate FROM orders
""")
def k_anonymity_orders(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return anonymize(df, {"o_orderdate": "k_anonymity"}, SET)


@query("""
    SELECT event_id, CASE WHEN user_id % 10 = 0 THEN NULL
        WHEN count(*) OVER (PARTITION BY user_id) >= 60 THEN user_id::VARCHAR ELSE '[SUPPRESSED]' END AS user_id,
        CASE WHEN count(*) OVER (PARTITION BY event_type) >= 2000 THEN event_type ELSE '[SUPPRESSED]' END AS event_type
    FROM events
""")
def k_anonymity_users(spark, d):
    df = table(spark, d, "events").selectExpr(
        "event_id", "CASE WHEN user_id % 10 <> 0 THEN user_id END AS user_id", "event_type"
    )
    policy = {"user_id": rule("k_anonymity", k=60), "event_type": rule("k_anonymity", k=2000)}
    return anonymize(df, policy, SET)


@query("""
    WITH classes AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer)
    SELECT c_custkey, CASE WHEN n >= 12 THEN c_nationkey::VARCHAR ELSE '[SUPPRESSED]' END AS c_nationkey,
        CASE WHEN n >= 12 THEN c_mktsegment ELSE '[SUPPRESSED]' END AS c_mktsegment FROM classes
""")
def k_anonymity_quasi(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return k_anonymity(df, ["c_nationkey", "c_mktsegment"], 12)


@query("""
    WITH classes AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer)
    SELECT c_custkey, c_nationkey, c_mktsegment FROM classes WHERE n >= 12
""")
def k_anonymity_drop(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return k_anonymity(df, ["c_nationkey", "c_mktsegment"], 12, drop=True)


@query(f"""
    WITH places AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders),
         a AS (SELECT o_orderpriority,
                row_number() OVER (ORDER BY {S.draw('o_orderpriority', 'o_orderkey')}) AS r FROM orders),
         b AS (SELECT o_totalprice, row_number() OVER (ORDER BY {S.draw('o_totalprice', 'o_orderkey')}) AS r FROM orders)
    SELECT o_orderkey, o_totalprice, o_orderpriority
    FROM places JOIN a USING (r) JOIN b USING (r)
""")
def shuffle_columns(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return anonymize(df, {"o_orderpriority": "shuffle", "o_totalprice": "shuffle"}, SET, ["o_orderkey"])


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query(f"""
    WITH places AS (SELECT {', '.join(_LINE)}, row_number() OVER (ORDER BY {', '.join(_LINE)}) AS r FROM lineitem),
         a AS (SELECT l_quantity, row_number() OVER (ORDER BY {S.draw('l_quantity', *_LINE)}) AS r FROM lineitem)
    SELECT {', '.join(_LINE)}, l_quantity FROM places JOIN a USING (r)
""")
def shuffle_composite_key(spark, d):
    df = table(spark, d, "lineitem").select(*_LINE, "l_quantity")
    return anonymize(df, {"l_quantity": "shuffle"}, SET, _LINE)


# --- policies and jobs ------------------------------------------------------------


@query("SELECT c_custkey, c_nationkey FROM customer")
def remove_columns(spark, d):
    return anonymize(table(spark, d, "customer"), {c: "remove" for c in ["c_name", "c_acctbal", "c_mktsegment"]}, SET)


_MULTI = f"""
    SELECT o_orderkey, 'ID_' || substr({S.digest('o_custkey::VARCHAR')}, 1, 8) AS o_custkey,
           {S.binned('o_totalprice', 10000)} AS o_totalprice, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)
           AS o_orderdate, {S.digest('o_orderpriority')} AS o_orderpriority FROM orders
"""


@query(_MULTI)
def policy_multi(spark, d):
    return anonymize(table(spark, d, "orders"), {
        "o_custkey": "pseudonymize",
        "o_orderstatus": "remove",
        "o_totalprice": rule("generalize_numeric", bin_size=10000),
        "o_orderdate": rule("generalize_date", granularity="quarter"),
        "o_orderpriority": {},
    }, SET)


@query(f"""
    WITH urgent AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'),
         places AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM urgent),
         prices AS (SELECT o_totalprice AS dealt,
             row_number() OVER (ORDER BY {S.draw('o_totalprice', 'o_orderkey')}) AS r FROM urgent),
         n AS (SELECT *, count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_orderdate) AS n FROM orders)
    SELECT o_orderkey, o_orderstatus, coalesce(dealt, o_totalprice) AS o_totalprice,
        CASE WHEN o_orderstatus = 'F' THEN repeat('*', length(o_orderpriority)) ELSE o_orderpriority END AS o_orderpriority,
        CASE WHEN o_orderstatus <> 'F' OR n >= 3 THEN {S.stamp('o_orderdate')} ELSE '[SUPPRESSED]' END AS o_orderdate,
        CASE WHEN o_totalprice > 100000 THEN {S.digest('o_custkey::VARCHAR')} ELSE o_custkey::VARCHAR END AS o_custkey
    FROM n LEFT JOIN places USING (o_orderkey) LEFT JOIN prices USING (r)
""")
def policy_where(spark, d):
    """Rules that hold for some rows: a mask, a digest, k-anonymity counted within them, values dealt among them."""
    return anonymize(table(spark, d, "orders"), {
        "o_orderpriority": {"method": "mask", "where": "o_orderstatus = 'F'"},
        "o_orderdate": {**rule("k_anonymity", k=3), "where": "o_orderstatus = 'F'"},
        "o_totalprice": {"method": "shuffle", "where": "o_orderpriority = '1-URGENT'"},
        "o_custkey": {"method": "hash", "where": "o_totalprice > 100000"},
    }, SET, ["o_orderkey"])


@query(f"""
    SELECT c_custkey, {S.digest('c_name')} AS c_name, c_mktsegment,
        CASE WHEN count(*) OVER (PARTITION BY c_nationkey) >= 60 THEN c_nationkey::VARCHAR
            ELSE '[SUPPRESSED]' END AS c_nationkey
    FROM customer
""")
def policy_names(spark, d):
    """Labels as method names, an unknown method and a pass-through."""
    df = table(spark, d, "customer").drop("c_acctbal")
    return anonymize(df, {
        "c_name": "scramble", "c_nationkey": rule("K-Anonymity", k=60), "c_mktsegment": "None"
    }, SET)


@query(f"""
    SELECT c_custkey, {S.digest("coalesce(nullif(c_nationkey, 3)::VARCHAR, 'nan')")} AS hashed,
        repeat('*', length(coalesce(nullif(c_nationkey, 3)::VARCHAR, 'nan'))) AS masked,
        CASE WHEN c_nationkey = 3 THEN NULL
            ELSE 'ID_' || substr({S.digest('c_nationkey::VARCHAR')}, 1, 8) END AS kept
    FROM customer
""")
def nulls_literal(spark, d):
    value = F.expr("nullif(c_nationkey, 3)")
    df = table(spark, d, "customer").select("c_custkey", *[value.alias(c) for c in ["hashed", "masked", "kept"]])
    return anonymize(df, {
        "hashed": "hash", "masked": "mask", "kept": rule("pseudonymize", nulls="keep")
    }, PARITY)


@query(f"""
    SELECT 'REC_' || substr({S.digest('c_custkey::VARCHAR')}, 1, 16) AS c_custkey, c_nationkey,
        {S.binned('c_acctbal', 500)} AS c_acctbal, c_mktsegment FROM customer
""")
def preset_hipaa(spark, d):
    roles = {"c_custkey": "record_number", "c_name": "name", "c_acctbal": "cost", "c_mktsegment": "finding"}
    return anonymize(table(spark, d, "customer"), preset("hipaa", roles), SET)


@query(f"""
    SELECT 'CARD_' || substr({S.digest('c_custkey::VARCHAR')}, 1, 24) AS c_custkey, c_nationkey, c_acctbal,
        repeat('*', length(c_mktsegment)) AS c_mktsegment
    FROM customer
""")
def preset_pci(spark, d):
    roles = {"c_custkey": "number", "c_name": "holder", "c_acctbal": "total", "c_mktsegment": "shown_number"}
    return anonymize(table(spark, d, "customer"), preset("pci", roles), SET)


@query(f"""
    WITH n AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT 'S_' || substr({S.digest('user_id::VARCHAR')}, 1, 16) AS user_id, {S.digest('event_id::VARCHAR')} AS event_id,
        year(ts) || '-Q' || quarter(ts) AS ts,
        CASE WHEN n >= 10 THEN event_type ELSE '[SUPPRESSED]' END AS event_type, value FROM n
""")
def preset_gdpr(spark, d):
    roles = {"user_id": "subject", "event_id": "online_identifier", "ts": "birth_date", "event_type": "place",
             "value": "country", "props": "free_text"}
    return anonymize(table(spark, d, "events"), preset("gdpr", roles), SET)


@query(f"""
    WITH n AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    SELECT 'C_' || substr({S.digest('c_name')}, 1, 12) AS c_name, {S.digest('c_custkey::VARCHAR')} AS c_custkey,
        round(c_acctbal + {S.laplace(S.u('c_acctbal', 'c_custkey'), 200.0)}, 4) AS c_acctbal,
        CASE WHEN n >= 20 THEN c_nationkey::VARCHAR ELSE '[SUPPRESSED]' END AS c_nationkey, c_mktsegment FROM n
""")
def preset_finance(spark, d):
    roles = {"c_name": "customer", "c_custkey": "account", "c_acctbal": "balance", "c_nationkey": "segment"}
    out = anonymize(table(spark, d, "customer"), preset("finance", roles), SET, ["c_custkey"])
    return _rounded(out, "c_acctbal")


@query(f"""
    WITH n AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
    SELECT 'P_' || substr({S.digest('s_suppkey::VARCHAR')}, 1, 12) AS s_suppkey, {S.binned('s_acctbal', 5000)} AS s_acctbal,
        CASE WHEN n >= 8 THEN s_nationkey::VARCHAR ELSE '[SUPPRESSED]' END AS s_nationkey FROM n
""")
def preset_hr(spark, d):
    roles = {"s_suppkey": "person", "s_name": "name", "s_acctbal": "pay", "s_nationkey": "team"}
    return anonymize(table(spark, d, "supplier"), preset("hr", roles), SET)


_ENDS = "CASE doc_id % 4 WHEN 0 THEN text || chr(13) WHEN 1 THEN chr(13) || chr(10) || text WHEN 2 THEN text END"


@query(f"SELECT doc_id, md5({_ENDS}) AS text FROM documents")
def csv_texts(spark, d):
    """Texts with quotes, commas and line breaks of all kinds, written as CSV and read back in many small blocks."""
    docs = table(spark, d, "documents").select("doc_id", F.expr(_ENDS).alias("text"))
    folder = scratch_path(spark)
    save_tables({"documents": docs}, folder, "csv", prefix="")
    block = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        back = load_tables(spark, folder, ["documents"], schemas={"documents": docs.schema}, nullValue="\0",
                           emptyValue="")["documents"]
        # The number of blocks is fixed with the plan.
        return materialize(back.select("doc_id", F.md5("text").alias("text")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)


@query(f"""
    WITH n AS (SELECT *, count(*) OVER (PARTITION BY o_orderdate) AS n FROM orders)
    SELECT o_orderkey, 'ID_' || substr({S.digest('o_custkey::VARCHAR')}, 1, 8) AS o_custkey,
        CASE WHEN n >= 4 THEN {S.stamp('o_orderdate')} ELSE '[SUPPRESSED]' END AS o_orderdate FROM n
    ORDER BY n.o_orderkey LIMIT 25
""")
def preview_orders(spark, d):
    """The first rows of a result; groups are counted over the whole table."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").orderBy("o_orderkey")
    policy = {"o_custkey": "pseudonymize", "o_orderdate": rule("k_anonymity", k=4)}
    return preview(orders, policy, SET, 25).orderBy("o_orderkey")


_KINDS_OF_COLUMNS = "CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' " \
    "WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END"


@query(f"""
    SELECT table_name AS "table", column_name AS "column", {_KINDS_OF_COLUMNS} AS type FROM information_schema.columns
    WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents',
        'embeddings', 'pages', 'benchmark', 'labels', 'conversations')
""")
def dataset_columns(spark, d):
    """What a policy can be written for: the columns of all tables of a dataset."""
    rows = [(t, c, kind) for t, columns in list_columns(spark, d).items() for c, kind in columns]
    return spark.createDataFrame(rows, 'table string, column string, type string')


@query(f"""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {S.digest('l_shipdate::DATE::VARCHAR')} AS shipped,
        round(l_quantity + (2 * {S.u('l_quantity', *_LINE)} - 1) * 3, 6) AS l_quantity FROM lineitem
""")
def policy_chunks(spark, d):
    """Chunks that are anonymized one by one make the same table as all rows at once."""
    lines = table(spark, d, "lineitem").select(*_LINE, F.to_date("l_shipdate").alias("shipped"), "l_quantity")
    policy = {"shipped": "hash", "l_quantity": rule("perturb", range=3)}
    chunks = [anonymize(lines.filter(F.pmod(F.xxhash64(*_LINE), F.lit(4)) == i), policy, SET, _LINE) for i in range(4)]
    return reduce(DataFrame.unionByName, chunks).withColumn("l_quantity", F.round("l_quantity", 6))


@query("""
    SELECT c_custkey, reverse(c_name) || '#' || length(c_name) AS c_name,
        CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS c_acctbal FROM customer
""")
def registered_methods(spark, d):
    """Two methods of one's own: a column function of the text, and one with an option."""
    def turned(build, name, c, dtype, options):
        return F.concat(F.reverse(c), F.lit("#"), F.length(c).cast("string"))

    def signed(build, name, c, dtype, options):
        return F.when(c < 0, options["below"]).otherwise("credit")

    for name, write, options in (("turned", turned, None), ("signed", signed, {"below": "minus"})):
        if registry.find(name) is None:
            registry.register_method(name, write, options)
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return anonymize(customers, {"c_name": "turned", "c_acctbal": rule("signed", below="debt")}, SET)


_TWO = {
    "customer": {"c_custkey": "hash", "c_name": "remove", "c_acctbal": rule("perturb", type="percentage")},
    "orders": {"o_custkey": "hash", "o_totalprice": rule("generalize_numeric", bin_size=100000)},
}
_TWO_SQL = f"""
    WITH c AS (SELECT {S.digest('c_custkey::VARCHAR')} AS k, c_mktsegment, c_acctbal
            + (2 * {S.u('customer.c_acctbal', 'c_custkey')} - 1) * 0.1::DOUBLE * c_acctbal AS c_acctbal FROM customer),
         o AS (SELECT {S.digest('o_custkey::VARCHAR')} AS k, {S.binned('o_totalprice', 100000)} AS o_totalprice FROM orders)
    SELECT c_mktsegment, o_totalprice, count(*) AS orders, count(DISTINCT k) AS customers,
        round(avg(c_acctbal), 3) AS balance
    FROM c JOIN o USING (k) GROUP BY ALL
"""


def _two_joined(c: DataFrame, o: DataFrame) -> DataFrame:
    joined = c.join(o, c["c_custkey"] == o["o_custkey"])
    return joined.groupBy("c_mktsegment", "o_totalprice").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_distinct("c_custkey").alias("customers"),
        F.round(F.avg("c_acctbal"), 3).alias("balance"),
    )


@query(_TWO_SQL)
def job_two_tables(spark, d):
    tables = {t: table(spark, d, t) for t in _TWO}
    out = anonymize_tables(tables, _TWO, SET, {"customer": ["c_custkey"]})
    return _two_joined(out["customer"], out["orders"])


@query(_TWO_SQL)
def job_files(spark, d):
    """The same from files to files."""
    out = scratch_path(spark)
    run_job(spark, d, out, _TWO, SET, tables=list(_TWO), row_keys={"customer": ["c_custkey"]},
            links=[("orders.o_custkey", "customer.c_custkey")])
    tables = load_tables(spark, out)
    return _two_joined(tables["anonymized_customer"], tables["anonymized_orders"])


@query(_MULTI.replace("o_orderkey,", "o_orderkey, o_orderstatus,", 1))
def csv_round_trip(spark, d):
    """Written as CSV, read back with a schema and anonymized."""
    orders = table(spark, d, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    folder = scratch_path(spark)
    save_tables({"orders": orders}, folder, "csv", prefix="")
    back = load_tables(spark, folder, ["orders"], schemas={"orders": orders.schema})["orders"]
    return anonymize(back, {
        "o_custkey": "pseudonymize",
        "o_totalprice": rule("generalize_numeric", bin_size=10000),
        "o_orderdate": rule("generalize_date", granularity="quarter"),
        "o_orderpriority": "hash",
    }, SET)


# --- mappings ---------------------------------------------------------------------

_LABELS = {f"NATION_{i}": f"Country {i % 4}" for i in range(0, 25, 2)}
_NATIONAL = "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _national(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(nation, "c_nationkey").select("c_custkey", "n_name")


@query(f"""
    WITH national AS ({_NATIONAL}), k AS (SELECT *, substr(n_name, 8)::INTEGER AS i FROM national)
    SELECT c_custkey, CASE WHEN i % 2 = 0 THEN 'Country ' || (i % 4) ELSE 'Elsewhere' END AS n_name FROM k
""")
def dictionary_map(spark, d):
    return mapping.map_values(_national(spark, d), "n_name", mapping.dictionary(spark, _LABELS), "Elsewhere")


@query("""
    SELECT c_custkey, CASE WHEN n_nationkey % 3 = 0 THEN 'unlisted' ELSE '"' || r_name || '" ' || n_nationkey END AS n_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def dictionary_file(spark, d):
    """A dictionary in a JSON file, made from the nations; some are left out of it."""
    region = table(spark, d, "region")
    pairs = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).filter(
        "n_nationkey % 3 > 0").selectExpr("n_name", """concat('"', r_name, '" ', n_nationkey) AS label""")
    folder = scratch_path(spark)
    pairs.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "label"))))).coalesce(1).write.text(folder)
    return mapping.map_values(_national(spark, d), "n_name", mapping.read_dictionary(spark, folder), "unlisted")


_REGIONAL = f"""
    SELECT c_custkey, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN {{}} ELSE {{}} END AS n_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def _hierarchy(spark, d):
    region = table(spark, d, "region")
    nations = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    upper = region.filter("r_name IN ('ASIA', 'EUROPE')").selectExpr("r_name AS value", "'EURASIA' AS parent")
    return nations.selectExpr("n_name AS value", "r_name AS parent").unionByName(upper)


@query(_REGIONAL.format("r_name", "r_name"))
def category_parent(spark, d):
    return mapping.generalize_category(_national(spark, d), "n_name", _hierarchy(spark, d))


@query(_REGIONAL.format("'EURASIA'", "r_name"))
def category_grandparent(spark, d):
    return mapping.generalize_category(_national(spark, d), "n_name", _hierarchy(spark, d), levels=2)


_CODES = f"""
         h AS (SELECT value, {S.digest('value')} AS h FROM v),
         n AS (SELECT *, count(*) OVER (PARTITION BY substr(h, 1, 4)) AS n4,
                count(*) OVER (PARTITION BY substr(h, 1, 8)) AS n8,
                count(*) OVER (PARTITION BY substr(h, 1, 16)) AS n16 FROM h),
         vault AS (SELECT value, 'ID_' || CASE WHEN n4 = 1 THEN substr(h, 1, 4) WHEN n8 = 1 THEN substr(h, 1, 8)
                WHEN n16 = 1 THEN substr(h, 1, 16) ELSE h END AS code, n4 > 1 AS widened FROM n)
"""
_VAULT = f"""
    WITH v AS (SELECT DISTINCT value FROM (SELECT o_orderkey::VARCHAR AS value FROM orders
            UNION ALL SELECT l_orderkey::VARCHAR FROM lineitem)), {_CODES}
"""


def _vault(spark, d):
    return mapping.build_vault(
        [(table(spark, d, "orders"), "o_orderkey"), (table(spark, d, "lineitem"), "l_orderkey")], SET, width=4
    )


@query(_VAULT + "SELECT value, code, widened FROM vault")
def vault_collisions(spark, d):
    return _vault(spark, d)


@query(_VAULT + """
    SELECT code AS l_orderkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity
    FROM lineitem JOIN vault ON value = l_orderkey::VARCHAR GROUP BY code
""")
def vault_apply(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    coded = mapping.apply_vault(lines, "l_orderkey", _vault(spark, d), SET)
    return coded.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(f"""
    WITH v AS (SELECT DISTINCT o_custkey::VARCHAR AS value FROM orders WHERE o_orderpriority = '1-URGENT'), {_CODES}
    SELECT coalesce(code, 'ID_' || {S.digest('c_custkey::VARCHAR')}) AS c_custkey, round(c_acctbal, 2) AS c_acctbal
    FROM customer LEFT JOIN vault ON value = c_custkey::VARCHAR
""")
def vault_unseen(spark, d):
    """Customers without an urgent order are not in the vault."""
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    vault = mapping.build_vault([(urgent, "o_custkey")], SET, width=4)
    customers = table(spark, d, "customer").selectExpr("c_custkey", "round(c_acctbal, 2) AS c_acctbal")
    return mapping.apply_vault(customers, "c_custkey", vault, SET)


_GROWN = f"""
    WITH v AS (SELECT o_orderkey::VARCHAR AS value, o_orderpriority = '1-URGENT' AS old FROM orders),
         h AS (SELECT *, {S.digest('value')} AS h FROM v),
         n AS (SELECT *, {', '.join(f"count(*) {f} OVER (PARTITION BY substr(h, 1, {w})) AS {a}{w}"
                                    for w in (4, 8, 16) for a, f in (('all', ''), ('old', 'FILTER (old)')))} FROM h)
    SELECT value, 'ID_' || CASE
            WHEN CASE WHEN old THEN old4 ELSE all4 END = 1 THEN substr(h, 1, 4)
            WHEN CASE WHEN old THEN old8 ELSE all8 END = 1 THEN substr(h, 1, 8)
            WHEN CASE WHEN old THEN old16 ELSE all16 END = 1 THEN substr(h, 1, 16) ELSE h END AS code,
        CASE WHEN old THEN 1 ELSE 2 END AS version FROM n
"""


@query(_GROWN)
def vault_grows(spark, d):
    """A vault of urgent orders, grown by all others: old codes stay, new ones make room."""
    orders, folder = table(spark, d, "orders"), scratch_path(spark)
    urgent = orders.filter("o_orderpriority = '1-URGENT'")
    mapping.grow_vault(spark, folder, [(urgent, "o_orderkey")], SET, width=4)
    grown = mapping.grow_vault(spark, folder, [(orders, "o_orderkey"), (urgent, "o_orderkey")], SET, width=4)
    return grown.select("value", "code", "version")


def _deep_hierarchy(spark, d):
    """Customers below nations, regions, for two of those EURASIA, and for all but two the WORLD."""
    people = _national(spark, d).selectExpr("cast(c_custkey AS string) AS value", "n_name AS parent")
    upper = table(spark, d, "region").filter("r_name IN ('AFRICA', 'ASIA', 'EUROPE')").selectExpr(
        "r_name AS value", "IF(r_name = 'AFRICA', 'WORLD', 'EURASIA') AS parent")
    top = spark.createDataFrame([("EURASIA", "WORLD"), ("WORLD", None), ("AMERICA", "AMERICA")], "value string, parent string")
    nations = _hierarchy(spark, d).filter("parent != 'EURASIA'")
    return people.unionByName(nations).unionByName(upper).unionByName(top)


_DEEP = """
    SELECT c_custkey AS id, CASE r_name WHEN 'AFRICA' THEN {} WHEN 'ASIA' THEN {} WHEN 'EUROPE' THEN {} ELSE {} END
        AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def _places(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey AS id", "cast(c_custkey AS string) AS place")


@query(_DEEP.format("'WORLD'", "'WORLD'", "'WORLD'", "r_name"))
def category_root(spark, d):
    return mapping.generalize_to_root(_places(spark, d), "place", _deep_hierarchy(spark, d))


@query(_DEEP.format("'AFRICA'", "'EURASIA'", "'EURASIA'", "n_name"))
def category_below_root(spark, d):
    """The same level below the root, from leaves of different depth."""
    return mapping.generalize_to_root(_places(spark, d), "place", _deep_hierarchy(spark, d), depth=1)


# --- audits -----------------------------------------------------------------------


def _profile_sql(source: str, columns: dict[str, str]) -> str:
    parts = [f"SELECT '{c}' AS \"column\", {text} AS value FROM {source}" for c, text in columns.items()]
    return f"""
        SELECT "column", sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (value IS NULL), 0)::BIGINT AS nulls,
            count(value) AS "distinct", min(n) FILTER (value IS NOT NULL) AS min_group,
            max(n) FILTER (value IS NOT NULL) AS max_group,
            round(coalesce(sum(n) FILTER (value IS NOT NULL AND n = 1), 0) / sum(n), 6) AS unique_share
        FROM (SELECT "column", value, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)
        GROUP BY "column"
    """


@query(_profile_sql("orders", {
    "o_orderkey": "o_orderkey::VARCHAR", "o_custkey": "o_custkey::VARCHAR", "o_orderstatus": "o_orderstatus",
    "o_orderdate": S.stamp("o_orderdate"), "o_orderpriority": "nullif(o_orderpriority, '5-LOW')",
}))
def audit_profile(spark, d):
    df = table(spark, d, "orders").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')"))
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    return audit.profile(df, columns).withColumn("unique_share", F.round("unique_share", 6))


@query("""
    SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY o_orderpriority
""")
def audit_frequencies(spark, d):
    return audit.frequencies(table(spark, d, "orders"), "o_orderpriority")


@query(f"""
    SELECT 'o_orderkey' AS "column", count(DISTINCT o_orderkey) AS distinct_before,
        count(DISTINCT substr({S.digest('o_orderkey::VARCHAR')}, 1, 5)) AS distinct_after,
        distinct_before = distinct_after AS kept FROM orders
    UNION ALL
    SELECT 'o_custkey', count(DISTINCT o_custkey), count(DISTINCT {S.digest('o_custkey::VARCHAR')}),
        count(DISTINCT o_custkey) = count(DISTINCT {S.digest('o_custkey::VARCHAR')}) FROM orders
""")
def audit_uniqueness(spark, d):
    before = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    after = anonymize(before, {"o_orderkey": rule("pseudonymize", length=5), "o_custkey": "hash"}, SET)
    return audit.uniqueness(before, after, ["o_orderkey", "o_custkey"])


_DRIFT = f"(o_totalprice + (2 * {_PRICE_U} - 1) * (abs(o_totalprice) * 0.1::DOUBLE))"


@query(f"""
    SELECT o_orderpriority, 'o_totalprice' AS "column", round(avg(o_totalprice), 3) AS mean_before,
        round(stddev_samp(o_totalprice), 3) AS std_before, round(avg({_DRIFT}), 3) AS mean_after,
        round(stddev_samp({_DRIFT}), 3) AS std_after,
        round(abs(avg({_DRIFT}) - avg(o_totalprice)) / abs(avg(o_totalprice)), 6) AS mean_shift,
        round(abs(stddev_samp({_DRIFT}) - stddev_samp(o_totalprice)) / stddev_samp(o_totalprice), 6) AS std_shift,
        true AS within
    FROM orders GROUP BY o_orderpriority
""")
def audit_drift(spark, d):
    before = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    after = anonymize(before, {"o_totalprice": "perturb"}, SET, ["o_orderkey"])
    out = audit.drift(before, after, ["o_totalprice"], ["o_orderpriority"])
    places = {"mean_before": 3, "std_before": 3, "mean_after": 3, "std_after": 3, "mean_shift": 6, "std_shift": 6}
    return out.withColumns({c: F.round(c, n) for c, n in places.items()})


def _exact_quantiles_sql(price: str, name: str) -> str:
    return f"""
        {name}_r AS (SELECT o_orderpriority, {price} AS x,
                row_number() OVER (PARTITION BY o_orderpriority ORDER BY {price}) AS r,
                count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
        {name} AS (SELECT o_orderpriority, quantile, x AS {name} FROM {name}_r, q WHERE r = ceil(quantile * n))
    """


_RANKS = "q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS quantile)"
_PRICES = f"""
    WITH {_RANKS}, {_exact_quantiles_sql('o_totalprice', 'before')}, {_exact_quantiles_sql(_DRIFT, 'after')},
        spread AS (SELECT o_orderpriority, max(before) FILTER (quantile = 0.75) - max(before) FILTER (quantile = 0.25)
            AS spread FROM before GROUP BY o_orderpriority),
        drift AS (SELECT *, abs(after - before) / spread AS shift
            FROM before JOIN after USING (o_orderpriority, quantile) JOIN spread USING (o_orderpriority))
"""


def _moved_prices(spark, d):
    before = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return before, anonymize(before, {"o_totalprice": "perturb"}, SET, ["o_orderkey"])


@query(_PRICES + """
    SELECT o_orderpriority, 'o_totalprice' AS "column", quantile, round(before, 3) AS before, round(after, 3) AS after,
        round(shift, 6) AS shift, shift <= 0.02 AS within FROM drift WHERE quantile IN (0.05, 0.5, 0.95)
""")
def audit_drift_quantiles_exact(spark, d):
    before, after = _moved_prices(spark, d)
    out = sketches.quantile_drift(before, after, ["o_totalprice"], ["o_orderpriority"], limit=0.02, exact=True)
    return out.withColumns({"before": F.round("before", 3), "after": F.round("after", 3), "shift": F.round("shift", 6)})


@query(f"""
    WITH {_RANKS} SELECT o_orderpriority, quantile, count(*) AS n, true AS before_in_bound, true AS after_in_bound
    FROM orders, q WHERE quantile NOT IN (0.25, 0.75) GROUP BY ALL
""")
def audit_drift_quantiles(spark, d):
    """Quantiles of stored, merged sketches; the share of rows below each is within twice the stated error."""
    folder, bound = scratch_path(spark), 2 * sketches.rank_error()
    sides = dict(zip(("before", "after"), _moved_prices(spark, d), strict=True))
    stored = {}
    for name, df in sides.items():
        for chunk in range(3):
            part = df.filter(F.col("o_orderkey") % 3 == chunk)
            sketches.quantile_sketches(part, ["o_totalprice"], ["o_orderpriority"]).write.parquet(
                f"{folder}/{name}/chunk={chunk}")
        stored[name] = spark.read.parquet(f"{folder}/{name}").drop("chunk")
    drift = sketches.quantile_drift(stored["before"], stored["after"], ["o_totalprice"], ["o_orderpriority"])
    out = drift.select("o_orderpriority", "quantile", "before", "after")
    for name, df in sides.items():
        x, value = F.col("o_totalprice"), F.col(name)
        shares = df.select("o_orderpriority", "o_totalprice").join(F.broadcast(out.select(
            "o_orderpriority", "quantile", name)), "o_orderpriority").groupBy("o_orderpriority", "quantile").agg(
            F.count(F.lit(1)).alias("n"), F.avg((x < value).cast("int")).alias("less"),
            F.avg((x <= value).cast("int")).alias("upto"))
        fits = (F.col("less") <= F.col("quantile") + bound) & (F.col("upto") >= F.col("quantile") - bound)
        checked = shares.select("o_orderpriority", "quantile", *(["n"] if name == "before" else []),
                                fits.alias(f"{name}_in_bound"))
        out = out.drop(name).join(checked, ["o_orderpriority", "quantile"])
    return out


_SKETCHED = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]


@query(" UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER ({x} IS NULL) AS nulls,
        count(DISTINCT {x}) AS "distinct", true AS in_bound, {str(c != 'o_orderkey').lower()} AS kept FROM orders
""" for c, x in zip(_SKETCHED, [*_SKETCHED[:3], "nullif(o_orderpriority, '5-LOW')"], strict=True)))
def audit_sketches(spark, d):
    """Distinct values from the stored sketches of chunks, beside the counted ones; one key lost half of its values."""
    folder, bits = scratch_path(spark), 12
    before = table(spark, d, "orders").select(*_SKETCHED).withColumn(
        "o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')"))
    after = before.withColumn("o_orderkey", F.floor(F.col("o_orderkey") / 2))
    merged = {}
    for name, df in {"before": before, "after": after}.items():
        chunked = df.withColumn("chunk", F.pmod("o_custkey", F.lit(4)))
        sketches.distinct_sketches(chunked, _SKETCHED, ["chunk"], bits).write.parquet(f"{folder}/{name}")
        merged[name] = sketches.merge_distinct([spark.read.parquet(f"{folder}/{name}")], bits=bits)
    counted = audit.profile(before).select("column", F.col("distinct").alias("counted"))
    kept = sketches.estimated_uniqueness(merged["before"], merged["after"], bits).select("column", "kept")
    off = F.abs(F.col("distinct") - F.col("counted"))
    return sketches.estimated_profile(merged["before"]).join(counted, "column").join(kept, "column").select(
        "column", "rows", "nulls", F.col("counted").alias("distinct"),
        (off <= F.col("counted") * sketches.distinct_error(bits)).alias("in_bound"), "kept")


@query("""
    WITH p AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT count(*) AS rows, count(DISTINCT o_custkey) AS keys,
        count(*) FILTER (c_custkey IS NULL) AS orphan_rows,
        count(DISTINCT o_custkey) FILTER (c_custkey IS NULL) AS orphan_keys
    FROM orders LEFT JOIN p ON o_custkey = c_custkey
""")
def audit_links(spark, d):
    orders = anonymize(table(spark, d, "orders").select("o_custkey"), {"o_custkey": "hash"}, SET)
    parents = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").select("c_custkey")
    return audit.links(orders, "o_custkey", anonymize(parents, {"c_custkey": "hash"}, SET), "c_custkey")


@query("""
    SELECT count(*) FILTER (l_partkey % 10 = l_suppkey % 10) AS equal_before,
        count(*) FILTER (l_partkey % 10 = l_suppkey % 10) AS equal_after, true AS kept FROM lineitem
""")
def audit_relationships(spark, d):
    before = table(spark, d, "lineitem").selectExpr("l_partkey % 10 AS a", "l_suppkey % 10 AS b")
    after = anonymize(before, {"a": "hash", "b": "hash"}, SET)
    return audit.relationships(before, after, "a", "b")


@query(f"""
    WITH k AS (SELECT o_custkey::VARCHAR AS old, {S.digest('o_custkey::VARCHAR')} AS new FROM orders
        UNION SELECT c_custkey::VARCHAR, {S.digest('c_custkey::VARCHAR')} FROM customer)
    SELECT 'customer.c_custkey' AS domain, count(*) AS keys, count(*) AS codes, 0::BIGINT AS merged, 0::BIGINT AS split,
        0::BIGINT AS lost, true AS holds FROM k
    UNION ALL
    SELECT 'lineitem.l_partkey', count(DISTINCT l_partkey), count(DISTINCT l_partkey), 1, 1, 0, false FROM lineitem
""")
def audit_bijection(spark, d):
    """Keys of two tables that keep their relation, and keys of two others with a merge and a split planted."""
    line = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    before = {"customer": table(spark, d, "customer").select("c_name", "c_custkey"),
              "orders": table(spark, d, "orders").select("o_orderkey", "o_custkey"),
              "lineitem": table(spark, d, "lineitem").select(*line, "l_partkey")}
    after = anonymize_tables(before, {"customer": {"c_custkey": "hash"}, "orders": {"o_custkey": "hash"}}, SET)
    # Parts 1 and 2 become one, part 3 becomes two.
    after["lineitem"] = before["lineitem"].withColumn("l_partkey", F.expr(
        "CASE WHEN l_partkey = 2 THEN 1 WHEN l_partkey = 3 AND l_linenumber % 2 = 0 THEN -3 ELSE l_partkey END"))
    keys = {"customer": ["c_name"], "orders": ["o_orderkey"], "lineitem": line}
    return audit.bijections(before, after, keys, [
        ("orders.o_custkey", "customer.c_custkey"), ("lineitem.l_partkey", "lineitem.l_partkey")])


_SHORT_PHONE = f"({_phone_sql('s')})"


@query(f"""
    WITH b AS (SELECT c_custkey, {PHONE} AS old FROM customer),
         a AS {_SHORT_PHONE},
         p AS (SELECT *, regexp_replace(old, '[^0-9]', '', 'g') AS x, regexp_replace(s, '[^0-9]', '', 'g') AS y
             FROM b JOIN a USING (c_custkey))
    SELECT 's' AS "column", count(*) AS values, count(*) FILTER (old = s) AS unchanged,
        count(*) FILTER (length(x) >= 4 AND len(list_filter(range(1, greatest(length(x) - 2, 1)),
            lambda i: instr(y, substr(x, i, 4)) > 0)) > 0) AS digit_runs,
        0::BIGINT AS missing_rows, 0::BIGINT AS extra_rows FROM p
""")
def audit_leaks(spark, d):
    before = table(spark, d, "customer").selectExpr("c_custkey", f"{PHONE} AS s")
    after = anonymize(before, {"s": "anonymize_phone"}, PARITY)
    return audit.leaks(before, after, ["c_custkey"], ["s"], digits=4)


@query(f"""
    WITH p AS (SELECT (2 * {_BAL_U} - 1) * 100 AS n FROM customer)
    SELECT 'c_acctbal' AS "column", count(*) AS values, round(min(n), 4) AS min_noise, round(max(n), 4) AS max_noise,
        round(avg(n), 4) AS mean_noise, round(stddev_samp(n), 4) AS std_noise,
        0::BIGINT AS missing_rows, 0::BIGINT AS extra_rows FROM p
""")
def audit_noise(spark, d):
    before = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    after = anonymize(before, {"c_acctbal": rule("perturb", range=100)}, SET, ["c_custkey"])
    out = audit.noise(before, after, ["c_custkey"], ["c_acctbal"])
    return out.withColumns({c: F.round(c, 4) for c in ["min_noise", "max_noise", "mean_noise", "std_noise"]})


@query("""
    WITH b AS (SELECT c_custkey, c_mktsegment AS old FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'),
         a AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE 'x' END AS new
             FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT 'c_mktsegment' AS "column", count(*) FILTER (old IS NOT NULL AND new IS NOT NULL) AS values,
        count(*) FILTER (old = new) AS unchanged, 0::BIGINT AS digit_runs,
        count(*) FILTER (new IS NULL) AS missing_rows, count(*) FILTER (old IS NULL) AS extra_rows
    FROM b FULL JOIN a USING (c_custkey)
""")
def audit_unpaired(spark, d):
    """A result that lacks rows, has rows of its own and kept some values."""
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    before = customers.filter("c_mktsegment <> 'AUTOMOBILE'")
    after = customers.filter("c_mktsegment <> 'BUILDING'").withColumn(
        "c_mktsegment", F.expr("CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE 'x' END"))
    return audit.leaks(before, after, ["c_custkey"], ["c_mktsegment"])


@query("""
    WITH o AS (SELECT nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_orderpriority <> '1-URGENT' AS kept,
            o_totalprice FROM orders)
    SELECT o_orderpriority, 'o_totalprice' AS "column", round(avg(o_totalprice), 3) AS mean_before,
        round(stddev_samp(o_totalprice), 3) AS std_before, round(avg(o_totalprice) FILTER (kept), 3) AS mean_after,
        round(stddev_samp(o_totalprice) FILTER (kept), 3) AS std_after, bool_and(kept) AS within
    FROM o GROUP BY o_orderpriority
""")
def audit_drift_segments(spark, d):
    """One segment is null, another is gone."""
    before = table(spark, d, "orders").selectExpr("nullif(o_orderpriority, '5-LOW') AS o_orderpriority", "o_totalprice")
    after = before.filter("NOT o_orderpriority <=> '1-URGENT'")
    out = audit.drift(before, after, ["o_totalprice"], ["o_orderpriority"]).drop("mean_shift", "std_shift")
    return out.withColumns({c: F.round(c, 3) for c in ["mean_before", "std_before", "mean_after", "std_after"]})


@query("""
    WITH n AS (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY ALL)
    SELECT 'o_orderdate' AS "column", count(*) FILTER (n >= 5) AS values, min(n) FILTER (n >= 5) AS min_group,
        0::BIGINT AS below_k, true AS holds FROM n
    UNION ALL
    SELECT 'o_custkey', count(*), min(n), count(*) FILTER (n < 5), count(*) FILTER (n < 5) = 0
    FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL)
""")
def audit_k_threshold(spark, d):
    df = table(spark, d, "orders").select("o_custkey", "o_orderdate")
    return audit.k_threshold(anonymize(df, {"o_orderdate": "k_anonymity"}, SET), ["o_custkey", "o_orderdate"], 5)


@query("""
    SELECT 'o_orderkey' AS "column", count(*) FILTER (n >= 5) AS values, 0::BIGINT AS below_k, true AS holds
    FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)
""")
def audit_k_suppressed(spark, d):
    """A column of which nothing is left still has its row."""
    orders = table(spark, d, "orders").select("o_orderkey")
    kept = anonymize(orders, {"o_orderkey": "k_anonymity"}, SET)
    return audit.k_threshold(kept, ["o_orderkey"], 5).drop("min_group")


@query("""
    SELECT size, count(*) AS classes, size * count(*) AS rows
    FROM (SELECT count(*) AS size FROM orders GROUP BY o_orderdate, o_orderpriority) GROUP BY size
""")
def audit_class_sizes(spark, d):
    return audit.class_sizes(table(spark, d, "orders"), ["o_orderdate", "o_orderpriority"])


@query("""
    WITH c AS (SELECT grouping(o_orderstatus, o_orderpriority, o_custkey)::BIGINT AS left_out, count(*) AS size
        FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority, o_custkey))
    SELECT left_out, count(*) AS classes, min(size) AS min_class FROM c GROUP BY left_out
""")
def audit_class_subsets(spark, d):
    return audit.class_sizes_by_subset(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("""
    WITH c AS (SELECT count(*) AS size, count(DISTINCT o_orderstatus) AS diversity
        FROM orders GROUP BY o_orderdate, o_orderpriority)
    SELECT sum(size)::BIGINT AS rows, count(*) AS classes, min(size) AS min_class, max(size) AS max_class,
        count(*) FILTER (size = 1) AS unique_rows, round(1.0::DOUBLE / min(size), 6) AS max_risk,
        round(count(*)::DOUBLE / sum(size), 6) AS mean_risk, min(diversity) AS min_diversity FROM c
""")
def audit_privacy(spark, d):
    out = audit.privacy_report(table(spark, d, "orders"), ["o_orderdate", "o_orderpriority"], "o_orderstatus")
    return out.withColumns({c: F.round(c, 6) for c in ["max_risk", "mean_risk"]})


_REPORT_QIS = ["o_orderdate", "o_orderpriority"]
_SUBSETS = " UNION ALL ".join(f"""
    SELECT '{','.join(qis)}' AS item, count(*) AS size FROM t GROUP BY {', '.join(qis)}
""" for qis in (_REPORT_QIS, _REPORT_QIS[:1], _REPORT_QIS[1:]))


@query(f"""
    WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS o_orderdate, o_orderpriority, o_orderstatus, o_totalprice,
            {_DRIFT} AS moved FROM orders),
        cells AS (SELECT o_orderdate, o_orderpriority, o_orderstatus, count(*) AS n FROM t GROUP BY ALL),
        overall AS (SELECT o_orderstatus, sum(n) / (SELECT count(*) FROM t) AS share FROM cells GROUP BY o_orderstatus),
        sized AS (SELECT *, sum(n) OVER (PARTITION BY o_orderdate, o_orderpriority) AS size FROM cells),
        c AS (SELECT o_orderdate, o_orderpriority, any_value(size) AS size, count(*) AS d, max(n / size) AS top,
            sum(greatest(n / size - share, 0)) AS off FROM sized JOIN overall USING (o_orderstatus) GROUP BY ALL),
        s AS ({_SUBSETS}),
        long AS (
            SELECT 'classes' AS section, 'count' AS item, count(*)::DOUBLE AS value FROM c
            UNION ALL SELECT 'classes', 'rows', sum(size) FROM c UNION ALL SELECT 'classes', 'min', min(size) FROM c
            UNION ALL SELECT 'classes', 'max', max(size) FROM c UNION ALL SELECT 'risk', 'max', 1.0 / min(size) FROM c
            UNION ALL SELECT 'risk', 'mean', count(*) / sum(size) FROM c
            UNION ALL SELECT 'risk', 'unique_rows', count(*) FILTER (size = 1) FROM c
            UNION ALL SELECT 'diversity', 'min_distinct', min(d) FROM c
            UNION ALL SELECT 'diversity', 'max_share', max(top) FROM c UNION ALL SELECT 'closeness', 'max', max(off) FROM c
            UNION ALL SELECT 'histogram', size::BIGINT::VARCHAR, count(*) FROM c GROUP BY size
            UNION ALL SELECT 'subset', item, min(size) FROM s GROUP BY item
            UNION ALL SELECT 'subset_classes', item, count(*) FROM s GROUP BY item
            UNION ALL SELECT 'unique', item, count(*) FILTER (size = 1) FROM s GROUP BY item
            UNION ALL SELECT 'mean_shift', 'o_totalprice', abs(avg(moved) - avg(o_totalprice)) / abs(avg(o_totalprice)) FROM t
            UNION ALL SELECT 'std_shift', 'o_totalprice', abs(stddev_samp(moved) - stddev_samp(o_totalprice))
                / stddev_samp(o_totalprice) FROM t)
    SELECT section, item, round(value, 7) AS value FROM long
""")
def audit_report(spark, d):
    """An anonymized table with its old prices beside the new ones, read once."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
    old = orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("old"))
    after = anonymize(orders, {"o_orderdate": "generalize_date", "o_totalprice": "perturb"}, SET, ["o_orderkey"])
    both = after.withColumnRenamed("o_totalprice", "new").join(old, F.col("o_orderkey") == F.col("key")).drop("key")
    report = audit.full_report(both.withColumnRenamed("old", "o_totalprice"), _REPORT_QIS, "o_orderstatus",
                               {"o_totalprice": "new"})
    return report.withColumn("value", F.round("value", 7))


_FRAMED = "(^|[^0-9])({})([^0-9]|$)"
_KINDS = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z][A-Za-z]",
    "phone": _FRAMED.format(r"(\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}"),
    "ssn": _FRAMED.format("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "card": _FRAMED.format("[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}"),
    "date": _FRAMED.format("[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"),
}


def _detect_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS kind, count({c}) AS values,
            count(*) FILTER (regexp_matches({c}, '{pattern}')) AS hits,
            count(*) FILTER (regexp_matches({c}, '{pattern}')) / count({c})::DOUBLE AS share FROM {source}"""
        for c in columns for kind, pattern in _KINDS.items()
    )


@query(_detect_sql("documents", ["text"]))
def detect_documents(spark, d):
    return detect_pii(table(spark, d, "documents"), ["text"])


@query(_detect_sql(f"(SELECT {MAIL} AS mail, {PHONE} AS phone, {SSN} AS ssn FROM customer)", ["mail", "phone", "ssn"]))
def detect_columns(spark, d):
    return detect_pii(table(spark, d, "customer").selectExpr(f"{MAIL} AS mail", f"{PHONE} AS phone", f"{SSN} AS ssn"))


_CARD15 = "cast(400000000000000 + c_custkey * 7919 AS string)"
_TYPED = {
    "key": ("c_custkey", "integer", "identifier", "true"),
    "nation": ("c_nationkey", "integer", "category", "true"),
    "balance": ("c_acctbal", "decimal", "measure", "true"),
    "mixed": ("CASE WHEN c_custkey % 2 = 0 THEN cast(c_nationkey AS string) ELSE '1.5' END", "decimal", "category", "true"),
    "segment": ("c_mktsegment", "text", "category", "true"),
    "mail": ("CASE WHEN c_custkey % 50 = 0 THEN 'none' ELSE concat('u', c_custkey, '@example.com') END", "email",
             "identifier", "c_custkey % 50 <> 0"),
    "number": ("concat(cast(c_custkey % 600 + 1 + 66 AS string), '-11-', cast(1000 + c_custkey % 9000 AS string))", "phone",
               "identifier", "true"),
    "tax": ("concat(cast(c_custkey % 500 + 100 AS string), '-11-', cast(1000 + c_custkey % 9000 AS string))", "ssn",
            "identifier", "true"),
    "iso": ("concat(2000 + c_custkey % 20, '-0', 1 + c_custkey % 9, '-1', c_custkey % 9)", "date_dashed", "attribute", "true"),
    "us": ("concat('0', 1 + c_custkey % 9, '/', 10 + c_custkey % 19, '/', 2000 + c_custkey % 20)", "date_month_first",
           "attribute", "true"),
    "dates": ("CASE c_custkey % 2 WHEN 0 THEN concat('2020-0', 1 + c_custkey % 9, '-1', c_custkey % 9)"
              " ELSE concat(10 + c_custkey % 19, '/0', 1 + c_custkey % 9, '/2001') END", "date", "attribute", "true"),
    "flag": ("CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'no' END", "boolean", "category", "true"),
    "note": ("concat('customer ', c_custkey % 700, ' lives in nation ', c_nationkey, ' and has ', c_custkey % 700)", "text",
             "identifier", "true"),
    "address": ("concat('10.', c_nationkey, '.', c_custkey % 250, '.1')", "ip", "identifier", "true"),
}


@query(" UNION ALL ".join(f"""
    SELECT '{name}' AS "column", count({text.replace('AS string', 'AS VARCHAR')}) AS values, 0::BIGINT AS nulls,
        '{kind}' AS type, round(count(*) FILTER ({hit}) / count(*)::DOUBLE, 6) AS share,
        CASE WHEN count(DISTINCT {text.replace('AS string', 'AS VARCHAR')}) >= 0.95 * count(*) AND '{kind}' <> 'decimal'
            THEN 'identifier' WHEN count(DISTINCT {text.replace('AS string', 'AS VARCHAR')}) <= greatest(20, 0.01 * count(*))
            THEN 'category' WHEN '{kind}' IN ('integer', 'decimal') THEN 'measure' WHEN '{name}' = 'note' THEN 'prose'
            ELSE 'attribute' END AS role,
        count(DISTINCT {text.replace('AS string', 'AS VARCHAR')}) AS "distinct" FROM customer
""" for name, (text, kind, _, hit) in _TYPED.items()) + """
    UNION ALL SELECT 'card', count(*), 0, 'card', 1.0, 'identifier', count(*) FROM customer
    UNION ALL SELECT 'no_card', count(*), 0, 'integer', 1.0, 'identifier', count(*) FROM customer
""")
def detect_types(spark, d):
    """Columns of one type, of mixed types, with a few odd values, and numbers with right and wrong check digits."""
    customers = table(spark, d, "customer").select(
        "*", *[F.expr(text).alias(name) for name, (text, *_) in _TYPED.items()], F.expr(_CARD15).alias("start"))
    # The check digit makes the sum of the digits, every second one doubled, a multiple of ten.
    doubled = F.expr("""aggregate(transform(split(start, ''), (c, i) -> IF(i % 2 = 0,
        IF(int(c) > 4, 2 * int(c) - 9, 2 * int(c)), int(c))), 0, (a, x) -> a + x)""")
    check = F.pmod(-doubled, F.lit(10))
    customers = customers.withColumns({
        "card": F.concat("start", check.cast("string")), "no_card": F.concat("start", ((check + 1) % 10).cast("string"))})
    out = value_types.detect_types(customers, [*_TYPED, "card", "no_card"]).drop("method")
    return out.withColumns({"share": F.round("share", 6), "distinct": F.round("distinct").cast("bigint")})


# --- streams ----------------------------------------------------------------------


@query("""
    WITH n AS (SELECT *, count(*) OVER (PARTITION BY date_trunc('day', ts), user_id) AS n FROM events)
    SELECT event_id, CASE WHEN n >= 3 THEN user_id::VARCHAR ELSE '[SUPPRESSED]' END AS user_id, value FROM n
""")
def events_daily_k(spark, d):
    df = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    return windowed_k_anonymity(df, "ts", "1 day", "user_id", 3, ["event_id"]).drop("ts")


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream to the end of its input and read what it wrote."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start(f"{folder}/rows")
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/rows")


@query(f"""
    SELECT event_id, 'ID_' || substr({S.digest('user_id::VARCHAR')}, 1, 8) AS user_id, {S.digest('event_type')} AS event_type,
        round(value + {S.laplace(S.u('value', 'event_id'), 1.0)}, 4) AS value FROM events
""")
def stream_policy(spark, d):
    stream = _stream(spark, d).drop("ts", "props")
    policy = {"user_id": "pseudonymize", "event_type": "hash", "value": "differential_privacy"}
    return _rounded(_drain(anonymize(stream, policy, SET, ["event_id"]), scratch_path(spark)), "value")


@query("""
    WITH n AS (SELECT *, count(*) OVER (PARTITION BY date_trunc('day', ts), user_id) AS n,
            max(date_trunc('day', ts)) OVER () AS last_day FROM events)
    SELECT event_id, CASE WHEN n >= 3 THEN user_id::VARCHAR ELSE '[SUPPRESSED]' END AS user_id, value FROM n
    WHERE date_trunc('day', ts) < last_day
""")
def stream_daily_k(spark, d):
    """Every row of a closed day; the last day stays open."""
    stream = _stream(spark, d).select("event_id", "ts", "user_id", "value")
    return _drain(windowed_k_anonymity(stream, "ts", "1 day", "user_id", 3, ["event_id"]), scratch_path(spark)).drop("ts")


@query(f"""
    WITH places AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS r FROM events),
         a AS (SELECT user_id, row_number() OVER (ORDER BY {S.draw('events#0.user_id', 'event_id')}) AS r FROM events)
    SELECT event_id, event_type, user_id FROM places JOIN a USING (r)
""")
def stream_shuffle(spark, d):
    """A stream of one batch, whose users change places within it."""
    folder = scratch_path(spark)
    stream = _stream(spark, d).select("event_id", "event_type", "user_id")
    writer = shuffle_batches(stream, ["user_id"], ["event_id"], SET, lambda batch, number: batch.write.parquet(
        f"{folder}/rows/batch={number}"), "events")
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch")


@query("""
    WITH n AS (SELECT *, count(*) OVER (PARTITION BY date_trunc('day', ts), user_id) AS n,
            max(date_trunc('day', ts)) OVER () AS last_day FROM events)
    SELECT event_id, CASE WHEN n >= 2 THEN user_id::VARCHAR ELSE '[SUPPRESSED]' END AS user_id FROM n
    WHERE date_trunc('day', ts) < last_day
""")
def stream_late_rows(spark, d):
    """Rows that come when their day is closed are dropped: here all events once more, in a second file."""
    events, folder = table(spark, d, "events").select("event_id", "ts", "user_id"), scratch_path(spark)
    for df in (events, events.withColumn("event_id", -F.col("event_id") - 1)):
        df.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        out = _drain(windowed_k_anonymity(stream, "ts", "1 day", "user_id", 2, ["event_id"]), f"{folder}/out")
    last = events.agg(F.date_trunc("day", F.max("ts")).alias("last"))
    return out.join(F.broadcast(last), F.date_trunc("day", "ts") < F.col("last")).select("event_id", "user_id")


_PAUSE = 3 * 3_600_000_000
_SESSIONS = f"""
    WITH e AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 86400000000 AS day FROM events),
         b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id, day ORDER BY us) <= {_PAUSE} THEN 0 ELSE 1
             END AS begins FROM e),
         s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id, day ORDER BY us RANGE UNBOUNDED PRECEDING) AS session
             FROM b),
         n AS (SELECT *, count(*) OVER w AS n, max(us) OVER w AS last_us, max(us) OVER () AS newest FROM s
             WINDOW w AS (PARTITION BY user_id, day, session))
    SELECT event_id, CASE WHEN n >= 2 THEN user_id::VARCHAR ELSE '[SUPPRESSED]' END AS user_id, value FROM n
"""


def _sessions(df):
    columns = df.select("event_id", "ts", "user_id", "value")
    return session_k_anonymity(columns, "ts", "3 hours", "user_id", 2, ["event_id"])


@query(_SESSIONS)
def events_session_k(spark, d):
    """Users with a single event in their session of a day."""
    return _sessions(table(spark, d, "events")).drop("ts")


@query(_SESSIONS + f" WHERE last_us + {_PAUSE} <= newest // 1000 * 1000")
def stream_session_k(spark, d):
    """Every row of a closed session; sessions up to three hours before the last event stay open."""
    return _drain(_sessions(_stream(spark, d)), scratch_path(spark)).drop("ts")


# --- generated tables -------------------------------------------------------------


def _sample_sql(tag: str):
    def at(name: str) -> str:
        return S.u(f"{tag}.{name}", "id")

    return at


_AT = _sample_sql("staff")
_CU = _sample_sql("customers")
_TX = _sample_sql("transactions")


def _ids(spark, d, name, key):
    """Row numbers for generated tables: the keys of a test table."""
    return table(spark, d, name).select(F.col(key).alias("id"))


def _spread(first: str, last: str) -> str:
    days = f"(DATE '{last}' - DATE '{first}')"
    return f"strftime(DATE '{first}' + cast((id * {days}) // (n - 1) AS INTEGER), '%Y-%m-%d')"


@query(f"""
    WITH r AS (SELECT c_custkey AS id, max(c_custkey) OVER () + 1 AS n FROM customer)
    SELECT id + 1 AS EmployeeID, {S.pick(_AT('name'), E.PEOPLE)} AS Name,
        {S.between(_AT('age'), 22, 65)} AS Age,
        replace(lower({S.pick(_AT('mail_name'), E.PEOPLE)}), ' ', '.') || id || '@'
            || replace(lower({S.pick(_AT('mail_firm'), E.FIRMS)}), ' ', '') || '.com' AS Email,
        '(' || {S.between(_AT('phone1'), 200, 999)} || ') ' || {S.between(_AT('phone2'), 200, 999)} || '-'
            || {S.between(_AT('phone3'), 1000, 9999)} AS Phone,
        {S.between(_AT('ssn1'), 100, 999)} || '-' || {S.between(_AT('ssn2'), 10, 99)} || '-'
            || {S.between(_AT('ssn3'), 1000, 9999)} AS SSN,
        {S.pick(_AT('company'), E.FIRMS)} AS Company,
        {S.pick(_AT('department'), E.DEPARTMENTS)} AS Department,
        {S.between(_AT('salary'), 40000, 150000)} AS Salary, {_spread('2020-01-01', '2023-12-31')} AS HireDate,
        {S.pick(_AT('city'), E.CITIES)} AS City, {S.pick(_AT('state'), E.STATES)} AS State,
        {S.between(_AT('credit'), 300, 850)} AS CreditScore, {S.between(_AT('bonus'), 0, 25000)} AS AnnualBonus,
        {S.between(_AT('projects'), 1, 15)} AS ProjectCount
    FROM r
""")
def sample_staff(spark, d):
    return samples.staff(spark, SET, _ids(spark, d, "customer", "c_custkey"))


_CUSTOMERS = f"""
    SELECT id + 1 AS CustomerID, {S.pick(_CU('name'), E.CLIENTS)} AS Name, 'customer' || (id + 1) || '@email.com' AS Email,
        '(' || {S.between(_CU('phone1'), 200, 999)} || ') ' || {S.between(_CU('phone2'), 200, 999)} || '-'
            || {S.between(_CU('phone3'), 1000, 9999)} AS Phone,
        {S.between(_CU('house'), 1, 9999)} || ' ' || {S.pick(_CU('street'), E.STREETS)} || ' St, City ' || (id + 1) AS Address,
        {S.pick(_CU('city'), E.CITIES[:5])} AS City, {S.pick(_CU('state'), E.STATES[:5])} AS State,
        {S.between(_CU('zip'), 10000, 99999)}::VARCHAR AS ZipCode, {S.between(_CU('credit'), 300, 850)} AS CreditScore,
        {S.between(_CU('income'), 30000, 200000)} AS AnnualIncome,
        round(100 + {_CU('balance')} * 49900, 2) AS AccountBalance, {_spread('2023-01-01', '2023-12-31')} AS LastPurchaseDate
"""
_TRANSACTIONS = f"""
    SELECT id + 1 AS TransactionID, cast(floor({_TX('customer')} * c) + 1 AS BIGINT) AS CustomerID,
        round(10 + {_TX('amount')} * 4990, 2) AS Amount, {_spread('2023-01-01', '2023-12-31')} AS TransactionDate,
        {S.pick(_TX('type'), E.TRANSACTION_TYPES)} AS TransactionType, {S.pick(_TX('merchant'), E.MERCHANTS)} AS MerchantName,
        {S.pick(_TX('category'), E.CATEGORIES)} AS Category, {S.pick(_TX('payment'), E.PAYMENTS)} AS PaymentMethod,
        {S.pick(_TX('location'), E.LOCATIONS)} AS Location
"""


@query(f"WITH r AS (SELECT c_custkey AS id, max(c_custkey) OVER () + 1 AS n FROM customer) {_CUSTOMERS} FROM r")
def sample_customers(spark, d):
    return samples.customers(spark, SET, _ids(spark, d, "customer", "c_custkey"))


@query(f"""
    WITH r AS (SELECT o_orderkey AS id, max(o_orderkey) OVER () + 1 AS n, (SELECT count(*) FROM customer) AS c FROM orders)
    {_TRANSACTIONS} FROM r
""")
def sample_sales(spark, d):
    people = table(spark, d, "customer").count()
    return samples.transactions(spark, SET, _ids(spark, d, "orders", "o_orderkey"), people)


@query(f"""
    WITH s AS (SELECT (count(*) // 500)::BIGINT AS scale FROM customer),
         c AS (SELECT unnest(range(100 * scale)) AS id, 100 * scale AS n, scale FROM s),
         t AS (SELECT unnest(range(200 * scale)) AS id, 200 * scale AS n, 100 * scale AS c FROM s),
         cs AS ({_CUSTOMERS} FROM c), ts AS ({_TRANSACTIONS} FROM t)
    SELECT TransactionID, CustomerID, Amount, MerchantName, Name, City, AccountBalance FROM ts JOIN cs USING (CustomerID)
""")
def sample_all(spark, d):
    """All sample tables at a scale taken from the customers; transactions with their customers."""
    tables = samples.sample_dataset(spark, SET, table(spark, d, "customer").count() // 500)
    sales = tables["Transactions"].join(tables["Customers"], "CustomerID")
    return sales.select("TransactionID", "CustomerID", "Amount", "MerchantName", "Name", "City", "AccountBalance")


@query(f"""
    WITH c AS (SELECT c_custkey AS id FROM customer), t AS (SELECT o_orderkey AS id FROM orders),
         cs AS (SELECT id + 1 AS CustomerID, {S.pick(_CU('city'), E.CITIES[:5])} AS City,
             round(100 + {_CU('balance')} * 49900, 2) AS AccountBalance FROM c),
         ts AS (SELECT cast(floor({_TX('customer')} * (SELECT count(*) FROM c)) + 1 AS BIGINT) AS CustomerID,
             round(10 + {_TX('amount')} * 4990, 2) AS Amount,
             {S.pick(_TX('type'), E.TRANSACTION_TYPES)} AS TransactionType FROM t)
    SELECT City, TransactionType, count(*) AS transactions, count(DISTINCT CustomerID) AS customers,
        round(sum(Amount), 2) AS amount, round(max(AccountBalance), 2) AS top_balance
    FROM ts JOIN cs USING (CustomerID) GROUP BY ALL
""")
def sample_transactions(spark, d):
    """Generated transactions join with generated customers on the customer number."""
    ids = _ids(spark, d, "customer", "c_custkey")
    people = samples.customers(spark, SET, ids).select("CustomerID", "City", "AccountBalance")
    sales = samples.transactions(spark, SET, _ids(spark, d, "orders", "o_orderkey"), ids.count())
    return sales.join(people, "CustomerID").groupBy("City", "TransactionType").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_distinct("CustomerID").alias("customers"),
        F.round(F.sum("Amount"), 2).alias("amount"),
        F.max("AccountBalance").alias("top_balance"),
    )


_EM = _sample_sql("employees")


@query(f"""
    WITH r AS (SELECT c_custkey AS id, max(c_custkey) OVER () + 1 AS n FROM customer)
    SELECT id + 1 AS EmployeeID, {S.pick(_EM('name'), E.PEOPLE[:10])} AS Name,
        {S.between(_EM('age'), 22, 65)} AS Age, {_spread('1960-01-01', '2000-12-31')} AS DateOfBirth,
        'employee' || (id + 1) || '@company.com' AS Email,
        '(' || {S.between(_EM('phone1'), 200, 999)} || ') ' || {S.between(_EM('phone2'), 200, 999)} || '-'
            || {S.between(_EM('phone3'), 1000, 9999)} AS Phone,
        {S.between(_EM('ssn1'), 100, 999)} || '-' || {S.between(_EM('ssn2'), 10, 99)} || '-'
            || {S.between(_EM('ssn3'), 1000, 9999)} AS SSN,
        {S.pick(_EM('department'), E.DEPARTMENTS)} AS Department,
        {S.between(_EM('salary'), 40000, 150000)} AS Salary, {_spread('2015-01-01', '2023-12-31')} AS HireDate,
        {S.pick(_EM('manager'), E.MANAGERS)} AS Manager,
        {S.between(_EM('house'), 1, 9999)} || ' ' || {S.pick(_EM('street'), E.STREETS)} || ' St, City '
            || (id + 1) AS Address,
        'Contact' || (id + 1) || '@family.com' AS EmergencyContact
    FROM r
""")
def sample_employees(spark, d):
    return samples.employees(spark, SET, _ids(spark, d, "customer", "c_custkey"))
