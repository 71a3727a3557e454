"""Projections, scalars, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as lk
from ..functions import rowwise as rw
from ..functions import safe
from ..functions import scalars as sc
from ..operators import aggs as ag
from ..operators import filters as fl
from ..operators import quality as qu
from ..sources.tables import EV_SQL, TXN_SQL, TXN_WIDE_SQL, Tables
from .registry import R, query, r, rs

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber"]

# -- projections -----------------------------------------------------------------


@query(
    "p01_select_by_type", "P01",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer",
)
def _(t: Tables):
    d = t.customer
    return d.select("c_custkey", *rw.categorical_columns(d))


@query(
    "p01_select_numeric", "P01",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
)
def _(t):
    d = t.orders
    return d.select("o_orderkey", *rw.numeric_columns(d, ignore=[*rw.datetime_columns(d), "o_orderkey"]))


@query("p02_select_by_name", "P02", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(t):
    d = t.part
    return d.select("p_partkey", *rw.columns_like(d, prefix="p_", pattern=r"(size|price)$"))


@query(
    "p03_pair_ratios", "P03",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"{R(f'{a} / nullif({b} + 1, 0)')} AS {a}_div_{b}" for i, a in enumerate(NUM) for b in NUM[i + 1 :]
    )
    + " FROM lineitem",
)
def _(t):
    cols = rw.pair_ratios(NUM, k=1)
    d = t.lineitem.select(*LINE_KEY, *cols)
    return rs(d, d.columns[2:])


@query(
    "p04_cross_ratios", "P04",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{R(f'{a} / nullif({b}, 0)')} AS {a}_per_{b}" for a in NUM[:2] for b in NUM[2:])
    + " FROM lineitem",
)
def _(t):
    d = t.lineitem.select(*LINE_KEY, *rw.cross_ratios(NUM[:2], NUM[2:], k=0))
    return rs(d, d.columns[2:])


@query(
    "p05_difference_distance_equality", "P05",
    f"""SELECT l_orderkey, l_linenumber, {R('l_discount - l_tax')} AS l_discount_minus_l_tax,
        {R('abs(l_discount - l_tax)')} AS l_discount_dist_l_tax,
        CASE WHEN l_discount = l_tax THEN 1 ELSE 0 END AS same FROM lineitem""",
)
def _(t):
    d = t.lineitem.select(
        *LINE_KEY, rw.difference("l_discount", "l_tax"), rw.distance("l_discount", "l_tax"),
        rw.same_flag("l_discount", "l_tax").alias("same"),
    )
    return rs(d, ["l_discount_minus_l_tax", "l_discount_dist_l_tax"])


_BLOCK = "[l_quantity, l_discount, l_tax]"


@query(
    "p06_block_stats", "P06",
    f"""SELECT l_orderkey, l_linenumber, {R(f'list_avg({_BLOCK})')} AS b_mean, {R(f'list_sum({_BLOCK})')} AS b_sum,
        {R(f'list_stddev_samp({_BLOCK})')} AS b_std, {R(f'list_max({_BLOCK})')} AS b_max,
        {R('l_quantity * l_discount * l_tax')} AS b_pro FROM lineitem""",
)
def _(t):
    d = t.lineitem.select(*LINE_KEY, *rw.block_stats(["l_quantity", "l_discount", "l_tax"], "b"))
    return rs(d, d.columns[2:])


@query(
    "p07_null_and_flag_counts", "P07",
    """SELECT l_orderkey, l_linenumber,
        CAST(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END + CASE WHEN l_tax = 0 THEN 1 ELSE 0 END AS INT) AS n_null,
        CAST((l_returnflag = 'A')::INT + (l_linestatus = 'O')::INT AS INT) AS m_sum FROM lineitem""",
)
def _(t):
    d = t.lineitem.withColumns(
        {"dn": F.nullif("l_discount", F.lit(0.0)), "tn": F.nullif("l_tax", F.lit(0.0))}
    )
    return d.select(
        *LINE_KEY,
        rw.null_count(["dn", "tn"]).alias("n_null"),
        rw.flag_sum([F.col("l_returnflag") == "A", F.col("l_linestatus") == "O"]).alias("m_sum"),
    )


@query(
    "p08_block_ratios", "P08",
    f"""SELECT l_orderkey, l_linenumber, {R('l_discount / (l_tax + 1)')} AS d_div_t,
        {R('l_quantity / (l_extendedprice + 1)')} AS q_div_amt FROM lineitem""",
)
def _(t):
    d = t.lineitem.select(
        *LINE_KEY,
        safe.ratio("l_discount", "l_tax", 1).alias("d_div_t"),
        safe.ratio("l_quantity", "l_extendedprice", 1).alias("q_div_amt"),
    )
    return rs(d, ["d_div_t", "q_div_amt"])


@query(
    "p09_split_by_category", "P09",
    """SELECT event_id, """
    + ", ".join(
        f"""CASE WHEN event_type = '{e}' THEN value ELSE -1 END AS "value__event_type-{e}" """
        for e in ["click", "error", "purchase", "signup", "view"]
    )
    + " FROM events",
)
def _(t):
    levels = ["click", "error", "purchase", "signup", "view"]
    return t.events.select("event_id", *rw.split_by_category("value", "event_type", levels, -1))


DEVICES = [
    "SM-G930V Build/NRD90M", "iOS Device", "Windows", "rv:57.0", "Moto G (5) Build/NPP", "hi6210sft Build/MRA58K",
    "Trident/7.0", "MacOS", "LG-M700 Build/NMF26X", "Linux", "XT1635-01", "HTC One", "BLADE A602", "Pixel Build/OPM",
    "Redmi Note 4/7.1", "unknown thing",
]
BROWSERS = [
    "chrome 63.0", "mobile safari 11.0", "samsung browser 6.2", "ie 11.0 for desktop", "edge 16.0", "firefox 57.0",
    "google search application 49.0", "mobile firefox", "opera 49.0", "android webview 4.0", "line app",
]
OSES = [
    "Android 7.0", "iOS 11.2.1", "Mac OS X 10_12_6", "Windows 10", "Windows XP", "iOS 1112", "Mac OS X 10136",
    "Windows Vista", "Android 711", "func", "Windows 8.1", "iOS 11.9.9",
]


def _identity(t: Tables):
    """Device texts picked by the customer key; they stand in for an identity table."""
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("c_custkey") % len(xs) + 1).cast("int"))
    return t.customer.select(
        "c_custkey", F.lower(pick(DEVICES)).alias("device"), pick(BROWSERS).alias("browser"), pick(OSES).alias("os_text")
    )


def _sql_list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


IDENTITY_SQL = f"""identity AS (SELECT c_custkey, lower({_sql_list(DEVICES)}[c_custkey % {len(DEVICES)} + 1]) AS device,
  {_sql_list(BROWSERS)}[c_custkey % {len(BROWSERS)} + 1] AS browser,
  {_sql_list(OSES)}[c_custkey % {len(OSES)} + 1] AS os_text FROM customer)"""


def _sql_rules(rules, default):
    parts = []
    for label, *tests in rules:
        cond = " AND ".join(f"contains({col}, '{tok}')" for col, tok in tests)
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + f" ELSE '{default}' END"


def _sql_device_name(col):
    out = col
    for label, tok in lk.DEVICE_NAMES:
        out = f"list_transform([{out}], lambda x: CASE WHEN contains(x, '{tok}') THEN '{label}' ELSE x END)[1]"
    return out


@query(
    "p10_decision_lists", "P10",
    f"""WITH {IDENTITY_SQL}, named AS (
        SELECT *, {_sql_device_name("split_part(device, '/', 1)")} AS device_name, lower(os_text) AS os FROM identity)
      SELECT c_custkey, device_name, {_sql_rules(lk.country_rules('device', 'browser'), 'Unk')} AS country,
        {_sql_rules(lk.device_os_rules('device_name', 'browser', 'os'), 'other_device_os')} AS device_os,
        {_sql_rules(lk.browser_name_rules('browser'), 'other_browser_name')} AS browser_name,
        {_sql_rules(lk.browser_os_rules('device_name', 'browser'), 'other_browser_os')} AS browser_os,
        (device_os = browser_os OR (device_os = 'mac' AND browser_name = 'chrome'))::INT AS os_match FROM named""",
)
def _(t):
    d = _identity(t)
    d = d.withColumns({"device_name": lk.device_name(sc.part("device", "/", 0)), "os": F.lower("os_text")})
    x = d.select(
        "c_custkey", "device_name", lk.device_country("device", "browser").alias("country"),
        lk.device_os("device_name", "browser", "os").alias("device_os"),
        lk.browser_name("browser").alias("browser_name"), lk.browser_os("device_name", "browser").alias("browser_os"),
    )
    return x.withColumn("os_match", lk.os_match("device_os", "browser_os", "browser_name"))


@query(
    "p11_threshold_ladder", "P11",
    """SELECT p_partkey, CASE WHEN p_size >= 40 THEN 40 WHEN p_size >= 20 THEN 20 WHEN p_size >= 10 THEN 10 ELSE -1 END AS size_step
       FROM part""",
)
def _(t):
    return t.part.select("p_partkey", rw.ladder("p_size", [(40, 40), (20, 20), (10, 10)], -1).alias("size_step"))


@query(
    "p12_dictionary_recode", "P12",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE -1 END AS status_code FROM orders""",
)
def _(t):
    return t.orders.select("o_orderkey", rw.recode("o_orderstatus", {"F": 1, "O": 0}, -1).alias("status_code"))


@query("p13_rename_by_replace", "P13", "SELECT c_custkey AS f__custkey, c_name AS f__name, c_nationkey AS f__nationkey FROM customer")
def _(t):
    return rw.rename_replace(t.customer.select("c_custkey", "c_name", "c_nationkey"), "c_", "f__")


@query(
    "p14_clip", "P14",
    f"""WITH {TXN_SQL}, top AS (SELECT max(amt) AS m FROM txn WHERE month = (SELECT max(month) FROM txn))
      SELECT txn_id, greatest(least(amt, 300000), 10000) AS clipped, least(amt, (SELECT m FROM top)) AS capped FROM txn""",
)
def _(t):
    d = t.txn.select("txn_id", "amt", "month")
    # the largest (month, amount) pair is the maximum of the last month
    latest = d.agg(F.max(F.struct("month", "amt"))["amt"]).scalar()
    return d.withColumn("_cap", latest).select(
        "txn_id", rw.clip("amt", 10000.0, 300000.0).alias("clipped"), rw.clip("amt", high=F.col("_cap")).alias("capped")
    )


@query(
    "p15_scale_and_log", "P15",
    f"""WITH {TXN_SQL} SELECT txn_id, {R("amt / (SELECT max(amt) FROM txn WHERE split = 'train')")} AS scaled,
      {R('ln(1 + amt)')} AS logged, {R('exp(ln(1 + amt)) - 1', 2)} AS back FROM txn""",
)
def _(t):
    d = t.txn.select("txn_id", "amt", "split")
    top = d.where("split = 'train'").agg(F.max("amt")).scalar()
    d = d.withColumn("_m", top)
    return d.select(
        "txn_id", r(safe.ratio("amt", "_m")).alias("scaled"), r(F.log1p("amt")).alias("logged"),
        r(F.expm1(F.log1p("amt")), 2).alias("back"),
    )


@query(
    "p16_narrowest_types", "P16",
    """WITH s AS (SELECT min(l_quantity) AS q0 FROM lineitem)
       SELECT 'l_linenumber' AS feature, CASE WHEN max(l_linenumber) < 127 THEN 'tinyint' ELSE 'smallint' END AS target FROM lineitem
       UNION ALL SELECT 'l_suppkey', CASE WHEN max(l_suppkey) < 127 THEN 'tinyint' WHEN max(l_suppkey) < 32767 THEN 'smallint' ELSE 'int' END FROM lineitem
       UNION ALL SELECT 'l_orderkey', CASE WHEN max(l_orderkey) < 127 THEN 'tinyint' WHEN max(l_orderkey) < 32767 THEN 'smallint' ELSE 'int' END FROM lineitem
       UNION ALL SELECT 'l_quantity', 'float' FROM s""",
)
def _(t):
    return qu.narrowest_types(t.lineitem, ["l_linenumber", "l_suppkey", "l_orderkey", "l_quantity"])


@query(
    "p16_downcast", "P16",
    "SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber, l_quantity FROM lineitem",
)
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    small = qu.downcast(d, d.columns)
    return small.select(
        F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("double")
    )


@query(
    "p17_binary_or_numeric", "P17",
    """SELECT 'l_linestatus' AS feature, 'categorical' AS kind UNION ALL
       SELECT 'l_tax', CASE WHEN count(DISTINCT l_tax) = 2 THEN 'binary' ELSE 'numeric' END FROM lineitem UNION ALL
       SELECT 'is_open', CASE WHEN count(DISTINCT (l_linestatus = 'O')::INT) = 2 THEN 'binary' ELSE 'numeric' END FROM lineitem""",
)
def _(t):
    d = t.lineitem.select("l_linestatus", "l_tax", (F.col("l_linestatus") == "O").cast("int").alias("is_open"))
    return qu.binary_or_numeric(d, ["l_linestatus", "l_tax", "is_open"], categorical=["l_linestatus"])


# -- filters ---------------------------------------------------------------------


@query("f01_split_by_label", "F01", f"WITH {TXN_SQL} SELECT txn_id, amt, label::DOUBLE AS label, CASE WHEN label IS NULL THEN 'test' ELSE 'train' END AS part FROM txn")
def _(t):
    train, test = fl.split_by_label(t.txn.select("txn_id", "amt", F.col("label").cast("double").alias("label")), "label")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "f02_membership", "F02",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
)
def _(t):
    rich = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return fl.members(t.orders.select("o_orderkey", "o_custkey"), rich, ["o_custkey"])


@query(
    "f03_boolean_ranges", "F03",
    """SELECT l_orderkey, l_linenumber FROM lineitem
       WHERE (l_quantity BETWEEN 5 AND 20 AND l_discount >= 0.05) OR (l_returnflag = 'R' AND l_tax = 0)""",
)
def _(t):
    small = F.col("l_quantity").between(5, 20) & (F.col("l_discount") >= 0.05)
    returned = (F.col("l_returnflag") == "R") & (F.col("l_tax") == 0)
    return t.lineitem.where(small | returned).select(*LINE_KEY)


@query(
    "f04_mask_unshared", "F04",
    f"""WITH {TXN_SQL}, ok AS (SELECT uid FROM txn GROUP BY uid
        HAVING count(*) > 2 AND count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'test') > 0)
      SELECT txn_id, coalesce(CASE WHEN uid IN (SELECT uid FROM ok) THEN uid END, -1) AS uid FROM txn""",
)
def _(t):
    d = fl.mask_unshared(t.txn.select("txn_id", "uid", "split"), "uid", "split", more_than=2)
    return d.select("txn_id", F.coalesce("uid", F.lit(-1)).alias("uid"))


@query(
    "f05_collapse_rare", "F05",
    """SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) < 10 THEN 'others' ELSE o_custkey::VARCHAR END AS cust FROM orders""",
)
def _(t):
    d = t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("cust"))
    return fl.collapse_rare(d, "cust", below=10).select("o_orderkey", "cust")


@query(
    "f06_null_shares", "F06",
    f"""SELECT 'disc' AS feature, {R("avg(CASE WHEN l_discount < 0.09 THEN 1.0 ELSE 0 END)")} AS null_share FROM lineitem
        UNION ALL SELECT 'l_tax', 0.0 FROM lineitem HAVING count(*) > 0""",
)
def _(t):
    d = t.lineitem.select(F.when(F.col("l_discount") >= 0.09, F.col("l_discount")).alias("disc"), "l_tax")
    return rs(fl.null_shares(d), ["null_share"])


@query("f06_drop_sparse_columns", "F06", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem")
def _(t):
    d = t.lineitem.select(*LINE_KEY, F.when(F.col("l_discount") >= 0.09, F.col("l_discount")).alias("disc"), "l_tax")
    return fl.drop_sparse_columns(d, 0.8)


@query(
    "f07_presence_in_other_split", "F07",
    f"""WITH {TXN_SQL} SELECT txn_id, CASE WHEN split = 'train' THEN (uid IN (SELECT uid FROM txn WHERE split = 'test'))::INT
        ELSE (uid IN (SELECT uid FROM txn WHERE split = 'train'))::INT END AS seen FROM txn""",
)
def _(t):
    return fl.in_other_split(t.txn.select("txn_id", "uid", "split"), "uid", "split", "seen").select("txn_id", "seen")


@query(
    "f08_position_cut", "F08",
    f"""WITH {TXN_SQL}, te AS (SELECT txn_id, row_number() OVER (ORDER BY txn_id) - 1 AS p, count(*) OVER () AS n FROM txn WHERE split = 'test')
      SELECT txn_id, CASE WHEN p < floor(n * 0.201) THEN 'public' ELSE 'private' END AS part FROM te""",
)
def _(t):
    te = t.txn.where("split = 'test'").select("txn_id")
    return fl.position_cut(te, "txn_id", 0.201, "public", "private", "part")


# -- scalars ---------------------------------------------------------------------


@query(
    "c01_text_functions", "C01",
    """SELECT p_partkey, lower(p_brand) AS low, replace(p_brand, '#', '.') AS dotted, split_part(p_name, ' ', 1) AS first_word,
       nullif(split_part(p_name, ' ', 2), '') AS second_word, contains(p_type, 'O')::INT AS has_o FROM part""",
)
def _(t):
    return t.part.select(
        "p_partkey", F.lower("p_brand").alias("low"), F.replace("p_brand", F.lit("#"), F.lit(".")).alias("dotted"),
        sc.first_token("p_name").alias("first_word"), sc.part("p_name", " ", 1).alias("second_word"),
        F.col("p_type").contains("O").cast("int").alias("has_o"),
    )


@query(
    "c02_letters_and_digits", "C02",
    r"""SELECT c_custkey, regexp_replace(c_name, '[^\p{L}]', '', 'g') AS letters, regexp_replace(c_name, '[^\p{N}]', '', 'g') AS digits FROM customer""",
)
def _(t):
    return t.customer.select("c_custkey", sc.letters_only("c_name").alias("letters"), sc.digits_only("c_name").alias("digits"))


MAILS = ["gmail.com", "yahoo.co.uk", "gmail", "att.net", "scranton.edu", "hotmail.fr", "web.de", "unknown.org"]
_mail_case = "CASE d " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lk.MAIL_PROVIDERS.items()) + " END"


@query(
    "c03_domain_parts", "C03",
    f"""WITH x AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, {_sql_list(MAILS)}[page_id % {len(MAILS)} + 1] AS d FROM pages)
      SELECT page_id, split_part(host, '.', 1) AS host_prefix, split_part(d, '.', 1) AS mail_prefix,
        CASE WHEN split_part(d, '.', -1) IN ('gmail', 'net', 'edu') THEN 'us' ELSE split_part(d, '.', -1) END AS mail_suffix,
        CASE WHEN split_part(host, '.', -1) IN ('gmail', 'net', 'edu') THEN 'us' ELSE split_part(host, '.', -1) END AS host_suffix,
        coalesce({_mail_case}, '?') AS provider, (({_mail_case}) IS NULL)::INT AS no_provider FROM x""",
)
def _(t):
    pick = F.element_at(F.array(*[F.lit(m) for m in MAILS]), (F.col("page_id") % len(MAILS) + 1).cast("int"))
    x = t.pages.select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"), pick.alias("d"))
    return x.select(
        "page_id", sc.domain_prefix("host").alias("host_prefix"), sc.domain_prefix("d").alias("mail_prefix"),
        sc.domain_suffix("d").alias("mail_suffix"), sc.domain_suffix("host").alias("host_suffix"),
        F.coalesce(lk.mail_provider("d"), F.lit("?")).alias("provider"),
        sc.missing_flag(lk.mail_provider("d")).alias("no_provider"),
    )


@query(
    "c04_size_pairs", "C04",
    f"""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN (p_size * 40)::VARCHAR
          ELSE (p_size * 40) || 'x' || (p_partkey % 1500) END AS s FROM part),
      y AS (SELECT p_partkey, coalesce(try_cast(nullif(split_part(s, 'x', 1), '') AS DOUBLE), -1.0) AS w,
          coalesce(try_cast(nullif(split_part(s, 'x', 2), '') AS DOUBLE), -1.0) AS h FROM x)
      SELECT p_partkey, w AS screen_width, h AS screen_height, (h > w)::INT AS screen_type, round_even(h / (w + 10), 2) + 0::DOUBLE AS screen_ratio FROM y""",
)
def _(t):
    w = (F.col("p_size") * 40).cast("string")
    s = F.when(F.col("p_size") % 7 == 0, None).when(F.col("p_size") % 11 == 0, w)
    s = s.otherwise(F.concat(w, F.lit("x"), (F.col("p_partkey") % 1500).cast("string")))
    return t.part.select("p_partkey", *sc.screen_columns(s))


@query(
    "c05_composite_key", "C05",
    """SELECT l_orderkey, l_linenumber, l_returnflag || '_' || coalesce((CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey END)::VARCHAR, '#')
       || '_' || l_linenumber::VARCHAR AS k FROM lineitem""",
)
def _(t):
    s = F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey"))
    return t.lineitem.select(*LINE_KEY, safe.composite_key(["l_returnflag", s, "l_linenumber"]).alias("k"))


@query(
    "c06_token_sentence", "C06",
    """SELECT p_partkey, 'p_brand_' || p_brand || ' p_type_' || p_type || ' p_size_' || p_size AS sentence FROM part""",
)
def _(t):
    return t.part.select("p_partkey", sc.token_sentence(["p_brand", "p_type", "p_size"]).alias("sentence"))


@query(
    "c07_offset_to_timestamp", "C07",
    """SELECT o_orderkey, strftime(TIMESTAMP '2017-12-01' + to_seconds(o_orderkey * 37 - 14400), '%Y-%m-%d %H:%M:%S') AS at FROM orders""",
)
def _(t):
    at = sc.offset_to_timestamp(F.col("o_orderkey") * 37, "2017-12-01 00:00:00")
    return t.orders.select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    "c08_date_parts", "C08",
    """SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, weekofyear(ts)::INT AS week, dayofyear(ts)::INT AS day_of_year,
       (isodow(ts) - 1)::INT AS day_week, hour(ts)::INT AS hour, day(ts)::INT AS day, ((year(ts) - 2017) * 12 + month(ts))::INT AS dt_m,
       ((year(ts) - 2017) * 52 + weekofyear(ts))::INT AS dt_w, ((year(ts) - 2017) * 365 + dayofyear(ts))::INT AS dt_d,
       (month(ts) = 12)::INT AS is_december FROM events""",
)
def _(t):
    return t.events.select("event_id", *sc.date_parts("ts", 2017))


_ZONES = "CASE " + " ".join(f"WHEN hh <= {b} THEN '{n}'" for b, n in sc.DAY_ZONES) + " ELSE '22.0-23.5' END"


@query(
    "c09_half_hour_and_zone", "C09",
    f"""WITH x AS (SELECT event_id, floor((floor(floor(epoch(ts)) * 100 / 86400) % 100) * 48 / 100) / 2 AS hh FROM events)
       SELECT event_id, hh AS half_hour, {_ZONES} AS zone FROM x""",
)
def _(t):
    d = t.events.select("event_id", sc.half_hour(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("half_hour"))
    return d.withColumn("zone", sc.day_zone("half_hour"))


@query(
    "c10_seconds_parts", "C10",
    """WITH x AS (SELECT event_id, epoch(ts)::BIGINT AS s FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events))
       SELECT event_id, s // 86400 AS day_no, (s // 86400) % 7 AS dow_no, (s // 3600) % 24 AS hour_no FROM x""",
)
def _(t):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", *sc.seconds_parts(s))


@query(
    "c11_date_arithmetic", "C11",
    """SELECT o_orderkey, strftime(o_orderdate::DATE + 45, '%Y-%m-%d') AS plus_days,
       strftime(o_orderdate + to_hours(30), '%Y-%m-%d %H:%M:%S') AS plus_hours,
       date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS since FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey", sc.add_days("o_orderdate", 45).cast("string").alias("plus_days"),
        F.date_format(sc.add_hours("o_orderdate", 30), "yyyy-MM-dd HH:mm:ss").alias("plus_hours"),
        sc.days_between("o_orderdate", F.lit("1995-01-01").cast("date")).alias("since"),
    )


@query(
    "c12_registration_date", "C12",
    """SELECT event_id, strftime(ts::DATE - coalesce(CASE WHEN k % 10 <> 0 THEN k END, 0), '%Y-%m-%d') AS regist_date
       FROM (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
)
def _(t):
    age = F.when(F.col("k") % 10 != 0, F.col("k"))
    return t.ev.select("event_id", sc.registration_date("ts", age).cast("string").alias("regist_date"))


_REL = ", ".join(f"('{o}', '{v}', DATE '{d}')" for o, vs in lk.OS_RELEASES.items() for v, d in vs.items())


def _os_columns(t):
    d = _identity(t)
    os = lk.normal_os_text("os_text")
    return d.select("c_custkey", sc.part(os, " ", 0).alias("os"), F.coalesce(sc.part(os, " ", 1), F.lit("0")).alias("version"))


OS_SQL = f"""{IDENTITY_SQL}, rel(os, version, released) AS (VALUES {_REL}),
  n AS (SELECT c_custkey, replace(replace(lower(os_text), '_', '.'), 'mac os x', 'mac') AS o FROM identity),
  p AS (SELECT c_custkey, split_part(o, ' ', 1) AS os, coalesce(nullif(split_part(o, ' ', 2), ''), '0') AS version FROM n),
  tries AS (
    SELECT c_custkey, 1 AS i, os, version AS v FROM p
    UNION ALL SELECT c_custkey, 2, os, version[1:2] || '.' || version[3:4] || '.' || version[5:5] FROM p WHERE os IN ('mac', 'ios') AND length(version) = 5
    UNION ALL SELECT c_custkey, 3, os, version[1:2] || '.' || version[3:4] FROM p WHERE os = 'mac' AND length(version) = 4
    UNION ALL SELECT c_custkey, 4, os, version[1:2] || '.' || version[3:3] || '.' || version[4:4] FROM p WHERE os IN ('mac', 'ios') AND length(version) = 4
    UNION ALL SELECT c_custkey, 5, os, version[1:2] || '.' || version[3:3] FROM p WHERE os = 'mac' AND length(version) = 3
    UNION ALL SELECT c_custkey, 6, os, version[1:1] || '.' || version[2:2] || '.' || version[3:3] FROM p WHERE os IN ('ios', 'android') AND length(version) = 3
    UNION ALL SELECT c_custkey, 7, os, CASE WHEN contains(version, 'x') THEN 'xp' WHEN contains(version, 'v') THEN 'vista'
      WHEN contains(version, '7') THEN '7' WHEN contains(version, '8') THEN '8' WHEN contains(version, '10') THEN '10' END FROM p WHERE os = 'windows'),
  os_date AS (SELECT p.c_custkey, p.os, p.version, min_by(rel.released, i) AS released
    FROM p LEFT JOIN tries USING (c_custkey) LEFT JOIN rel ON rel.os = tries.os AND rel.version = tries.v
    GROUP BY ALL)"""


@query(
    "j08_versioned_lookup", "J08",
    f"""WITH {OS_SQL.replace("min_by(rel.released, i)", "arg_min(rel.released, i) FILTER (rel.released IS NOT NULL)")}
      SELECT c_custkey, os, version, coalesce(strftime(released, '%Y-%m-%d'), 'none') AS released FROM os_date""",
)
def _(t):
    d = _os_columns(t)
    rel = F.coalesce(lk.os_release_date("os", "version").cast("string"), F.lit("none"))
    return d.select("c_custkey", "os", "version", rel.alias("released"))


@query(
    "c13_release_age", "C13",
    f"""WITH {OS_SQL.replace("min_by(rel.released, i)", "arg_min(rel.released, i) FILTER (rel.released IS NOT NULL)")}
      SELECT o_orderkey, coalesce(date_diff('day', released, o_orderdate::DATE), 0)::INT AS age,
        (released IS NULL)::INT AS unknown FROM orders LEFT JOIN os_date ON o_custkey = c_custkey""",
)
def _(t):
    d = _os_columns(t).select(F.col("c_custkey").alias("o_custkey"), lk.os_release_date("os", "version").alias("released"))
    j = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(d, "o_custkey", "left")
    return j.select(
        "o_orderkey", F.coalesce(sc.day_age("o_orderdate", "released"), F.lit(0)).alias("age"),
        sc.missing_flag("released").alias("unknown"),
    )


# US federal holidays 1995-2001, observed dates, for the comparison.
_HOLIDAYS = """1995-01-02 1995-01-16 1995-02-20 1995-05-29 1995-07-04 1995-09-04 1995-10-09 1995-11-10 1995-11-23 1995-12-25
1996-01-01 1996-01-15 1996-02-19 1996-05-27 1996-07-04 1996-09-02 1996-10-14 1996-11-11 1996-11-28 1996-12-25
1997-01-01 1997-01-20 1997-02-17 1997-05-26 1997-07-04 1997-09-01 1997-10-13 1997-11-11 1997-11-27 1997-12-25
1998-01-01 1998-01-19 1998-02-16 1998-05-25 1998-07-03 1998-09-07 1998-10-12 1998-11-11 1998-11-26 1998-12-25
1999-01-01 1999-01-18 1999-02-15 1999-05-31 1999-07-05 1999-09-06 1999-10-11 1999-11-11 1999-11-25 1999-12-24 1999-12-31
2000-01-17 2000-02-21 2000-05-29 2000-07-04 2000-09-04 2000-10-09 2000-11-10 2000-11-23 2000-12-25
2001-01-01 2001-01-15 2001-02-19 2001-05-28 2001-07-04 2001-09-03 2001-10-08 2001-11-12 2001-11-22 2001-12-25""".split()


@query(
    "c14_holiday_flags", "C14",
    f"""SELECT o_orderkey, (strftime(o_orderdate, '%Y-%m-%d') IN ({', '.join(f"'{d}'" for d in _HOLIDAYS)}))::INT AS is_holiday,
       (month(o_orderdate) = 12)::INT AS is_december FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey", sc.is_us_holiday("o_orderdate").alias("is_holiday"), (F.month("o_orderdate") == 12).cast("int").alias("is_december")
    )


MODULI = [2, 5, 25, 50, 100, 200]


@query(
    "c15_cents_and_modulo", "C15",
    f"""SELECT o_orderkey, {R('o_totalprice - floor(o_totalprice)', 2)} AS cents, """
    + ", ".join(f"(trunc(o_totalprice)::BIGINT) % {m} AS amt_x{m}" for m in MODULI)
    + " FROM orders",
)
def _(t):
    return t.orders.select(
        "o_orderkey", r(sc.cents("o_totalprice"), 2).alias("cents"),
        *[sc.amount_modulo("o_totalprice", m).alias(f"amt_x{m}") for m in MODULI],
    )


@query(
    "c16_decimal_digits", "C16",
    "SELECT o_orderkey, trunc((o_totalprice - trunc(o_totalprice)) * 1000)::BIGINT AS digits FROM orders",
)
def _(t):
    return t.orders.select("o_orderkey", sc.decimal_digits("o_totalprice").alias("digits"))


@query(
    "c17_rounding", "C17",
    """WITH x AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
      y AS (SELECT o_orderkey, o_totalprice AS v, o_totalprice::VARCHAR AS s, length(trunc(o_totalprice)::BIGINT::VARCHAR) AS w, hi, lo FROM orders, x)
      SELECT o_orderkey, round_even(v / 1000, 0) AS even, CASE WHEN w > 1 THEN CASE WHEN s LIKE '%0' THEN CASE WHEN trunc(hi - lo) > 10 THEN 0 ELSE 2 END ELSE 1 END
        ELSE CASE WHEN length(s) - w - 1 > 3 THEN 3 ELSE 2 END END AS digits FROM y""",
)
def _(t):
    d = t.orders.select("o_orderkey", "o_totalprice")
    s = d.agg(F.struct(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).alias("s")).scalar()
    d = d.withColumn("_s", s)
    return d.select(
        "o_orderkey", sc.round_even(F.col("o_totalprice") / 1000).alias("even"),
        sc.round_digits("o_totalprice", F.col("_s.hi"), F.col("_s.lo")).alias("digits"),
    )


@query(
    "c18_sigmoid", "C18",
    f"SELECT event_id, {R('1 / (1 + exp(-value / 100))')} AS p, CASE WHEN value > -1 AND value < 1999 THEN {R('ln(((value + 1) / 2000) / (1 - (value + 1) / 2000))')} END AS odds FROM events",
)
def _(t):
    odds = F.when((F.col("value") > -1) & (F.col("value") < 1999), r(sc.log_odds((F.col("value") + 1) / 2000)))
    return t.events.select("event_id", r(sc.sigmoid(F.col("value") / 100)).alias("p"), odds.alias("odds"))


@query(
    "c19_missing_values", "C19",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS d, nullif(l_tax, 0) AS t,
          CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS f FROM lineitem),
      m AS (SELECT f FROM x WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1)
      SELECT l_orderkey, l_linenumber, (d IS NULL)::INT AS d_na, coalesce(d, -1.0) AS d_const,
        {R('coalesce(t, (SELECT avg(t) FROM x))')} AS t_mean, coalesce(f, (SELECT f FROM m)) AS f_mode FROM x""",
)
def _(t):
    x = t.lineitem.select(
        *LINE_KEY, F.nullif("l_discount", F.lit(0.0)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("t_mean"),
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("f_mode"),
    )
    x = x.withColumns({"d_na": sc.missing_flag("d"), "d_const": F.col("d")}).drop("d")
    x = ag.mode_fill(sc.fill_values(x, {"d_const": -1.0}, ["t_mean"]), "f_mode")
    return rs(x, ["t_mean"])


@query(
    "c20_replace_infinite", "C20",
    """WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE WHEN l_tax = 0 THEN '-inf'::DOUBLE ELSE l_quantity END AS v FROM lineitem),
      b AS (SELECT max(v) AS hi, min(v) AS lo FROM x WHERE isfinite(v))
      SELECT l_orderkey, l_linenumber, CASE WHEN v = 'inf'::DOUBLE THEN hi WHEN v = '-inf'::DOUBLE THEN lo ELSE v END AS v FROM x, b""",
)
def _(t):
    inf = float("inf")
    v = F.when(F.col("l_discount") == 0, F.lit(inf)).when(F.col("l_tax") == 0, F.lit(-inf)).otherwise(F.col("l_quantity"))
    return sc.replace_inf(t.lineitem.select(*LINE_KEY, v.alias("v")), ["v"])
