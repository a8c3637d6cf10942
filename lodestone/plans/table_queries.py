"""The generic operators on ordinary tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import generic as G
from lodestone.operators.shared_windows import shared_windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PRIORITIES = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}
EVENT_RANK = {"error": 4, "purchase": 3, "signup": 2, "click": 1, "view": 0}
EVENT_RANK_SQL = "case event_type when 'error' then 4 when 'purchase' then 3 when 'signup' then 2 when 'click' then 1 when 'view' then 0 end"


def query(sql: str | None = None):
    """Registers a function of the tables by its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SECRET_SQL = """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents),
k as (select doc_id, line_no, case
  when regexp_matches(line, '(?i)(example|changeme|placeholder|your[_-]|xxxx|dummy|<[^>]+>|\\$\\{|os\\.environ|getenv)') then null
  when regexp_matches(line, '-----BEGIN [A-Z ]*PRIVATE KEY-----') then 'private-key'
  when regexp_matches(line, 'AKIA[0-9A-Z]{16}') then 'aws-access-key'
  when regexp_matches(line, '[Bb]earer +[A-Za-z0-9._~+/-]{20,}') then 'bearer-token'
  when regexp_matches(line, '[a-z][a-z0-9+]*://[^/ :@]+:[^/ :@]+@[^ /]+') then 'connection-string'
  when regexp_matches(line, '(?i)(?:password|passwd|secret|token|api_?key)["'']? *[:=] *["''][^"'']{8,}["'']') then 'assignment' end as kind from l)
"""


@query(SECRET_SQL + "select doc_id, cast(min(line_no) as bigint) as first_line, count(*) as n_findings, string_agg(distinct kind, ',' order by kind) as kinds from k where kind is not null group by doc_id")
def secret_scan(t) -> DataFrame:
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    found = lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), T.secret_kind(F.col("line")).alias("kind")).where("kind is not null")
    return found.groupBy("doc_id").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_findings"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query(
    "select doc_id, md5(m) as masked_md5, m <> text as redacted from (select doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,"
    " '-----BEGIN [A-Z ]*PRIVATE KEY-----', '***', 'g'), 'AKIA[0-9A-Z]{16}', '***', 'g'), '[Bb]earer +[A-Za-z0-9._~+/-]{20,}', '***', 'g'), '[a-z][a-z0-9+]*://[^/ :@]+:[^/ :@]+@[^ /]+', '***', 'g'),"
    " '(?i)(?:password|passwd|secret|token|api_?key)[\"'']? *[:=] *[\"''][^\"'']{8,}[\"'']', '***', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', '***@mail', 'g') as m from documents)"
)
def redact_text(t) -> DataFrame:
    m = T.masked(F.col("text"))
    return t("documents").select("doc_id", F.md5(m).alias("masked_md5"), (m != F.col("text")).alias("redacted"))


@query("select o_orderkey, c_name, o_orderpriority from orders join customer on o_custkey = c_custkey where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus in ('O', 'P') and contains(lower(c_name), '#00000001')")
def findings_filter_search(t) -> DataFrame:
    wanted = t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("O", "P"))
    who = t("customer").where(F.contains(F.lower("c_name"), F.lit("#00000001"))).select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return wanted.join(who, "o_custkey").select("o_orderkey", "c_name", "o_orderpriority")


@query("select o_orderkey, o_orderpriority, (select count(*) from orders) as total from orders where o_orderstatus = 'O' order by o_orderpriority, o_custkey, o_orderkey limit 50 offset 50")
def severity_sort_page(t) -> DataFrame:
    orders = t("orders")
    total = orders.agg(F.count("*").alias("total"))  # counted before any filter; one row
    top = G.page(orders.where("o_orderstatus = 'O'"), [G.rank_of("o_orderpriority", PRIORITIES), F.col("o_custkey"), F.col("o_orderkey")], 2, 50)
    return top.join(F.broadcast(total)).select("o_orderkey", "o_orderpriority", "total")


@query(
    "select count(*) as total, count(*) filter (l_returnflag = 'A') as n_a, count(*) filter (l_returnflag = 'N') as n_n, count(*) filter (l_returnflag = 'R') as n_r, count(*) filter (l_returnflag = 'X') as n_x,"
    " (select string_agg(l_linestatus || '=' || n, ',' order by l_linestatus) from (select l_linestatus, count(*) n from lineitem group by 1)) as by_status from lineitem"
)
def summary_zero_filled(t) -> DataFrame:
    by = t("lineitem").groupBy("l_returnflag", "l_linestatus").count()
    flags = [F.sum(F.when(F.col("l_returnflag") == x, F.col("count")).otherwise(0)).alias(f"n_{x.lower()}") for x in "ANRX"]
    status = by.groupBy("l_linestatus").agg(F.sum("count").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("l_linestatus", F.lit("="), "n"))), ",").alias("by_status"))
    return by.agg(F.sum("count").alias("total"), *flags).join(F.broadcast(status))


@query("select lang, source, count(*) as n, cast(sum(n_chars) as bigint) as n_chars from documents where lang is not null group by lang, source")
def language_summary(t) -> DataFrame:
    return t("documents").where("lang is not null").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


EDGES_SQL = "with e as (select distinct l_partkey % 97 as src, l_suppkey % 89 as dst from lineitem), r as (select * from e where src <> dst), n as (select unnest(range(100)) as node)"


def _edges(t) -> DataFrame:
    return t("lineitem").select((F.col("l_partkey") % 97).alias("src"), (F.col("l_suppkey") % 89).alias("dst"))


@query(
    EDGES_SQL + " select node, (select count(distinct dst) from r where src = node) as fan_out, (select count(distinct src) from r where dst = node) as fan_in,"
    " (select count(*) from (select dst from r where src = node union select src from r where dst = node)) as coupling from n"
)
def fan_in_out_coupling(t) -> DataFrame:
    nodes = t("lineitem").sparkSession.range(100).withColumnRenamed("id", "node")
    return G.degrees(_edges(t), nodes)


@query(
    "select l_partkey % 50 as src, l_suppkey % 40 as dst, string_agg(distinct cast(l_linenumber as varchar), ',' order by cast(l_linenumber as varchar)) as sites, cast(min(l_linenumber) as int) as first_site,"
    " bool_or(l_returnflag = 'R') as conditional, bool_or(l_linestatus = 'O' and l_returnflag = 'A') as deferred from lineitem group by 1, 2"
)
def edge_merge(t) -> DataFrame:
    edges = t("lineitem").select((F.col("l_partkey") % 50).alias("src"), (F.col("l_suppkey") % 40).alias("dst"), F.col("l_linenumber").alias("site"), (F.col("l_returnflag") == "R").alias("conditional"), ((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A")).alias("deferred"))
    return G.merged_edges(edges).withColumn("sites", F.array_join(F.col("sites").cast("array<string>"), ","))


@query("with c as (select o_custkey, count(*) as n from orders group by 1) select max(n) as peak, string_agg(cast(o_custkey as varchar), ',' order by cast(o_custkey as varchar)) as names from c where n = (select max(n) from c)")
def fan_peak(t) -> DataFrame:
    return G.peak(t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "n", "o_custkey")


@query("select o_custkey, count(*) as n, case when count(*) >= 30 then 'Medium' else 'Low' end as severity from orders group by 1 having count(*) > 15")
def threshold_rule(t) -> DataFrame:
    return G.over_threshold(t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "n", 15)


@query("select l_orderkey, count(*) as n_lines, cast(sum(l_quantity) as bigint) as quantity, case when count(*) > 6 and sum(l_quantity) > 150 then 'Medium' else 'Low' end as severity from lineitem group by 1 having count(*) > 6 or sum(l_quantity) > 150")
def either_signal_rule(t) -> DataFrame:
    sums = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").cast("long").alias("quantity"))
    a, b = F.col("n_lines") > 6, F.col("quantity") > 150
    return sums.where(a | b).withColumn("severity", F.when(a & b, "Medium").otherwise("Low"))


@query(
    "with s as (select c_custkey as k, 'balance' as signal from customer where c_acctbal < 0 union all select o_custkey, 'orders' from orders group by 1 having count(*) > 12 union all select o_custkey, 'urgent' from orders where o_orderpriority = '1-URGENT' group by 1 having count(*) > 3)"
    " select k as custkey, count(distinct signal) as n_signals, string_agg(distinct signal, ',' order by signal) as signals from s group by 1 having count(distinct signal) >= 2"
)
def multi_category_candidates(t) -> DataFrame:
    orders = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    signals = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("custkey"), F.lit("balance").alias("signal"))
    signals = signals.unionByName(orders.select(F.col("o_custkey").alias("custkey"), F.explode(F.array_compact(F.array(F.when(F.col("n") > 12, "orders"), F.when(F.col("u") > 3, "urgent")))).alias("signal")))
    return signals.groupBy("custkey").agg(F.collect_set("signal").alias("s")).where("size(s) >= 2").select("custkey", F.size("s").cast("long").alias("n_signals"), F.array_join(F.array_sort("s"), ",").alias("signals"))


@query("select p_name as name, p_brand as brand, count(distinct p_size) as n_versions, string_agg(distinct cast(p_size as varchar), ',' order by cast(p_size as varchar)) as versions from part group by 1, 2 having count(distinct p_size) >= 2")
def duplicate_versions(t) -> DataFrame:
    found = t("part").groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_set(F.col("p_size").cast("string"))).alias("v"))
    return found.where("size(v) >= 2").select("name", "brand", F.size("v").cast("long").alias("n_versions"), F.array_join("v", ",").alias("versions"))


@query("select r_name, count(*) as n from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1 having count(*) > 3")
def count_per_scope(t) -> DataFrame:
    by = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).count()  # summed before the joins
    return by.join(t("nation"), "n_nationkey").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sum("count").alias("n")).where("n > 3")


@query("select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45 and l_partkey is not null)")
def unused_candidates(t) -> DataFrame:
    used = t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t("part").select("p_partkey", "p_name").join(used, "p_partkey", "left_anti")


@query("select lang, quality, toxic, count(*) as n_occurrences, min(doc_id) as first_doc from documents join labels using (doc_id) where quality = 0 or toxic = 1 group by 1, 2, 3")
def known_vulnerability(t) -> DataFrame:
    return t("labels").where("quality = 0 or toxic = 1").join(t("documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n_occurrences"), F.min("doc_id").alias("first_doc"))


@query(
    "select c_custkey, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O') then 'direct' when exists (select 1 from orders where o_custkey = c_custkey) then 'transitive' else 'unknown' end as kind from customer"
)
def classify_direct_transitive(t) -> DataFrame:
    flags = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("open"))
    return t("customer").select("c_custkey").join(flags, "c_custkey", "left").select("c_custkey", F.when(F.col("open"), "direct").when(F.col("open").isNotNull(), "transitive").otherwise("unknown").alias("kind"))


@query(
    "with p as (select page_id, regexp_extract(url, '://([^?#]*)', 1) as path from pages), t as (select distinct regexp_extract(path, '^([^/]*/[^/]*)', 1) as target from p where contains(path, '/') union select distinct regexp_extract(path, '^([^/]*)', 1) from p)"
    " select page_id, (select max_by(target, length(target)) from t where path = target or starts_with(path, target || '/')) as target from p"
)
def longest_prefix_join(t) -> DataFrame:
    pages = t("pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    table = pages.where("contains(path, '/')").select(F.regexp_extract("path", "^([^/]*/[^/]*)", 1).alias("target"))
    table = table.union(pages.select(F.regexp_extract("path", "^([^/]*)", 1)))
    return G.longest_prefix(pages, "page_id", "path", table, "target").select("page_id", "target")


@query("select a.event_id, b.event_id as last_click from (select * from events where event_type = 'purchase') a asof left join (select * from events where event_type = 'click') b on a.user_id = b.user_id and a.ts > b.ts")
def latest_before(t) -> DataFrame:
    events = t("events").select("user_id", "ts", "event_id", "event_type")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return G.latest_before(events.where("event_type = 'purchase'"), clicks, "user_id", "ts", "click", F.to_date("ts")).select("event_id", F.col("last_click").alias("last_click"))


BLOCKS_SQL = "with b as (select event_id, user_id, event_id // 64 as scope, event_id % 64 as s, least(63, event_id % 64 + user_id % 17) as e from events)"


@query(BLOCKS_SQL + " select event_id, 1 + (select count(*) from (select distinct x.s, x.e from b x where x.scope = b.scope and x.s <= b.s and x.e >= b.e and (x.s < b.s or x.e > b.e))) as depth from b")
def interval_containment(t) -> DataFrame:
    s = F.col("event_id") % 64
    blocks = t("events").select("event_id", F.floor(F.col("event_id") / 64).alias("scope"), s.alias("start"), F.least(F.lit(63), s + F.col("user_id") % 17).alias("end"))
    return G.nesting(blocks, ["scope"]).select("event_id", "depth")


@query("select a.n_name as source, b.n_name as target from nation a join nation b on b.n_nationkey = (a.n_nationkey * 7 + 3) % 25 where a.n_regionkey > b.n_regionkey")
def layer_violation(t) -> DataFrame:
    nation = t("nation")
    edges = nation.select("n_nationkey", ((F.col("n_nationkey") * 7 + 3) % 25).alias("to"))
    a, b = (nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(name), F.col("n_regionkey").alias(f"{name}_rank")) for k, name in (("n_nationkey", "source"), ("to", "target")))
    return edges.join(F.broadcast(a), "n_nationkey").join(F.broadcast(b), "to").where("source_rank > target_rank").select("source", "target")


@query("select l_partkey % 97 as node, count(*) as n from lineitem where l_partkey % 97 = l_suppkey % 89 group by 1")
def self_loops(t) -> DataFrame:
    return _edges(t).where("src = dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))


REACH_SQL = "with recursive e as (select n_nationkey as src, (n_nationkey * 3 + n_regionkey) % 25 as dst from nation), c as (select src, dst, 1 as d from e union select c.src, e.dst, d + 1 from c join e on c.dst = e.src where d < 8)"


def _nations(t) -> DataFrame:
    return t("nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 3 + F.col("n_regionkey")) % 25).alias("dst"))


@query(REACH_SQL + " select distinct src, dst from c")
def reachability_bounded(t) -> DataFrame:
    return G.reachable(_nations(t), 8)


@query(
    "with recursive s as (select n_regionkey as region, s_suppkey as src, s_acctbal >= 0 as good from supplier join nation on s_nationkey = n_nationkey), e as (select region, src, coalesce((select min(b.src) from s b where b.region = s.region and b.good and b.src > s.src), (select min(b.src) from s b where b.region = s.region and b.good)) as dst from s)"
    ", c as (select region, src, dst from e where dst is not null union select c.region, c.src, e.dst from c join e on c.region = e.region and c.dst = e.src where e.dst is not null)"
    " select region, a.src as node, min(a.dst) as component from c a where exists (select 1 from c b where b.region = a.region and b.src = a.dst and b.dst = a.src) group by 1, 2"
)
def circular_dependency(t) -> DataFrame:
    """Every supplier points to the next one of its region with a balance, the last to the first: one long ring per region."""
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), F.col("s_suppkey").alias("src"), F.when(F.col("s_acctbal") >= 0, F.col("s_suppkey")).alias("good"))
    region = Window.partitionBy("region")
    after = F.min("good").over(region.orderBy("src").rowsBetween(1, Window.unboundedFollowing))
    return G.strong_components(s.select("region", "src", F.coalesce(after, F.min("good").over(region)).alias("dst")).where("dst is not null"), "region")


@query("with b as (select * from orders where o_orderdate < timestamp '1999-01-01'), g as (select * from orders where o_orderdate >= timestamp '1998-01-01') select coalesce(b.o_orderkey, g.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'new' when g.o_orderkey is null then 'resolved' else 'unchanged' end as state from b full join g on b.o_orderkey = g.o_orderkey")
def snapshot_compare(t) -> DataFrame:
    orders = t("orders")
    return G.compared(orders.where("o_orderdate < timestamp '1999-01-01'"), orders.where("o_orderdate >= timestamp '1998-01-01'"), "o_orderkey").select("o_orderkey", "state")


@query(
    "with q as (select distinct o_orderpriority from orders where o_orderdate >= timestamp '2001-07-20'), s as (select distinct o_custkey from orders where o_orderdate >= timestamp '2001-06-01')"
    " select o_orderkey, o_orderpriority in (select * from q) and o_orderpriority <> '5-LOW' or o_custkey in (select * from s) as qualified from orders where o_orderdate < timestamp '1996-01-01'"
)
def comparison_qualified(t) -> DataFrame:
    orders = t("orders")
    areas = orders.where("o_orderdate >= timestamp '2001-07-20' and o_orderpriority <> '5-LOW'").select("o_orderpriority").distinct().withColumn("by_area", F.lit(True))
    rules = orders.where("o_orderdate >= timestamp '2001-06-01'").select("o_custkey").distinct().withColumn("by_rule", F.lit(True))
    gone = orders.where("o_orderdate < timestamp '1996-01-01'").join(areas, "o_orderpriority", "left").join(rules, "o_custkey", "left")
    return gone.select("o_orderkey", F.coalesce("by_area", "by_rule", F.lit(False)).alias("qualified"))


@query(
    "with w as (select doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '') as w from documents),"
    " h as (select doc_id, sha256(array_to_string(w[i + 1 : i + 50], chr(0))) as h from w, lateral (select unnest(range(0, len(w) - 49)) as i)),"
    " g as (select h from h group by h having count(distinct doc_id) > 1) select doc_id, count(distinct h) as n_shared from h where h in (select h from g) group by 1"
)
def ngram_duplicate_groups(t) -> DataFrame:
    return shared_windows(t("documents"), "doc_id", "text")


@query(
    "with m as (select l_returnflag, l_linestatus, l_linenumber, l_suppkey % 5 as bucket, count(*) as value from lineitem where l_quantity > 10 group by 1, 2, 3, 4)"
    " select a.l_returnflag, a.l_linestatus, a.l_linenumber, a.bucket, a.n, m.value from (select l_returnflag, l_linestatus, l_linenumber, l_suppkey % 5 as bucket, count(*) as n from lineitem group by 1, 2, 3, 4) a left join m using (l_returnflag, l_linestatus, l_linenumber, bucket)"
)
def metric_join_evidence(t) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus", "l_linenumber", "bucket"]
    lines = t("lineitem").withColumn("bucket", F.col("l_suppkey") % 5)
    metrics = lines.where("l_quantity > 10").groupBy(*keys).agg(F.count("*").alias("value"))
    return lines.groupBy(*keys).agg(F.count("*").alias("n")).join(metrics, keys, "left")


@query("select l_partkey % 1000 as path, l_linenumber as line, count(*) as signal_count, string_agg(l_returnflag || '=' || cast(l_quantity as int), ',' order by l_returnflag || '=' || cast(l_quantity as int)) as signals from lineitem where l_discount >= 0.08 group by 1, 2 having count(*) >= 2")
def hotspots(t) -> DataFrame:
    signal = F.concat("l_returnflag", F.lit("="), F.col("l_quantity").cast("int"))
    found = t("lineitem").where("l_discount >= 0.08").groupBy((F.col("l_partkey") % 1000).alias("path"), F.col("l_linenumber").alias("line")).agg(F.count("*").alias("signal_count"), F.array_join(F.array_sort(F.collect_list(signal)), ",").alias("signals"))
    return found.where("signal_count >= 2")


@query(
    "with p as (select regexp_extract(url, '://([^?#]*)', 1) as path, length(html) as n from pages), d as (select array_to_string(string_split(path, '/')[1:i], '/') as directory, n from p, lateral (select unnest(range(1, len(string_split(path, '/')) + 1)) as i))"
    " select directory, count(*) as n_pages, cast(sum(n) as bigint) as n_chars from d group by 1"
)
def path_rollup(t) -> DataFrame:
    pages = t("pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"), F.char_length("html").cast("long").alias("n"))
    return G.rolled_up(pages, "path", F.count("*").alias("n_pages"), F.sum("n").alias("n_chars"))


@query(f"select user_id, max_by(event_type, {EVENT_RANK_SQL}) as worst, count(*) as n from events group by 1")
def worst_state(t) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.max_by("event_type", G.rank_of("event_type", EVENT_RANK)).alias("worst"), F.count("*").alias("n"))


@query(
    "select user_id, case when count(*) filter (event_type = 'error') > 15 then 'Analysis failed' when count(*) filter (event_type = 'error') > 12 then 'Completed with limitations' when count(*) filter (event_type = 'purchase') = 0 then 'Not evaluated'"
    " when count(*) filter (event_type = 'signup') > 10 then null else 'No findings detected' end as state from events group by 1"
)
def domain_state(t) -> DataFrame:
    n = {x: F.count_if(F.col("event_type") == x).alias(x) for x in ("error", "purchase", "signup")}
    state = F.when(F.col("error") > 15, "Analysis failed").when(F.col("error") > 12, "Completed with limitations").when(F.col("purchase") == 0, "Not evaluated").when(F.col("signup") > 10, F.lit(None)).otherwise("No findings detected")
    return t("events").groupBy("user_id").agg(*n.values()).select("user_id", state.alias("state"))


@query(
    "select doc_id, area, state from (select doc_id, area, case when text = '' then 'Not analyzed' when n_chars > 5000 and area in ('security', 'architecture') then 'Partially analyzed' when lang <> 'en' and area = 'dependency' then 'Not analyzed' else 'Fully analyzed' end as state"
    " from documents, (select unnest(['security', 'dependency', 'architecture', 'code_structure']) as area)) where state <> 'Fully analyzed'"
)
def file_coverage_sparse(t) -> DataFrame:
    areas = F.explode(F.array(*[F.lit(a) for a in ("security", "dependency", "architecture", "code_structure")])).alias("area")
    rows = t("documents").select("doc_id", (F.col("text") == "").alias("void"), "n_chars", "lang", areas)
    state = F.when(F.col("void"), "Not analyzed").when((F.col("n_chars") > 5000) & F.col("area").isin("security", "architecture"), "Partially analyzed").when((F.col("lang") != "en") & (F.col("area") == "dependency"), "Not analyzed").otherwise("Fully analyzed")
    return rows.select("doc_id", "area", state.alias("state")).where("state <> 'Fully analyzed'")


@query("select min(doc_id) as doc_id, md5(text) as digest, count(*) as copies from documents where text is not null group by text")
def dedupe_first(t) -> DataFrame:
    docs = t("documents").where("text is not null").select("doc_id", F.md5("text").alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("select doc_id, source, place from (select doc_id, source, row_number() over (partition by md5(text), source order by doc_id) as place from documents where text is not null) where place > 1")
def cross_domain_dedupe(t) -> DataFrame:
    docs = t("documents").where("text is not null").select("doc_id", "source", F.md5("text").alias("digest"))
    return G.repeated(docs, ["digest", "source"], [F.col("doc_id")]).select("doc_id", "source", "place")


@query("select o_orderkey, o_totalprice, (select greatest(count(*) - 100, 0) from orders) as left_out from orders order by o_totalprice desc, o_orderkey limit 100")
def budget_cut(t) -> DataFrame:
    kept, rest = G.budget(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100)
    return kept.join(F.broadcast(rest))


@query("select o_custkey, o_orderkey, printf('F-%04d', row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)) as finding_id from orders")
def finding_number(t) -> DataFrame:
    return G.numbered(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "finding_id")


@query("select l_orderkey, l_linenumber, sha256('[\"' || l_returnflag || '\",' || l_partkey || ',' || l_suppkey || ',\"' || l_linestatus || '\"]') as identity_key from lineitem")
def identity_hash(t) -> DataFrame:
    key = T.identity(T.json_text(F.col("l_returnflag")), F.col("l_partkey"), F.col("l_suppkey"), T.json_text(F.col("l_linestatus")))
    return t("lineitem").select("l_orderkey", "l_linenumber", key.alias("identity_key"))


@query(
    "with l as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null), f as (select doc_id, l, 1 + doc_id % len(l) as focus from l)"
    " select doc_id, focus, greatest(1, focus - 10) as start_line, least(len(l), focus + 40) as end_line, md5(array_to_string(l[greatest(1, focus - 10) : least(len(l), focus + 40)], chr(10))) as window_md5 from f"
)
def evidence_window(t) -> DataFrame:
    docs = t("documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("l"))
    docs = docs.withColumn("focus", 1 + F.col("doc_id") % F.size("l"))
    start, end = F.greatest(F.lit(1), F.col("focus") - 10), F.least(F.size("l"), F.col("focus") + 40)
    return docs.select("doc_id", "focus", start.alias("start_line"), end.alias("end_line"), F.md5(F.array_join(F.slice("l", start.cast("int"), (end - start + 1).cast("int")), "\n")).alias("window_md5"))


@query("select p_partkey, lower(regexp_replace(trim(p_name) || '_' || p_type || '.' || p_brand, '[-_.]+', '-', 'g')) as name from part")
def name_normalize(t) -> DataFrame:
    return t("part").select("p_partkey", T.python_package(F.concat(F.trim("p_name"), F.lit("_"), "p_type", F.lit("."), "p_brand"))).toDF("p_partkey", "name")


@query(
    "with s as (select p_partkey, case p_partkey % 6 when 0 then '==' || p_size || '.0' when 1 then '>=' || p_size when 2 then p_size || '.*' when 3 then '*' when 4 then 'git+https://x/y' else '~' || p_size || '.1' end as t from part)"
    " select p_partkey, case p_partkey % 6 when 0 then 'exact' when 1 then 'range' when 2 then 'wildcard' when 3 then 'any' when 4 then 'url' else 'range' end as kind from s"
)
def specifier_kind(t) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    text = F.when(k == 0, F.concat(F.lit("=="), size, F.lit(".0"))).when(k == 1, F.concat(F.lit(">="), size)).when(k == 2, F.concat(size, F.lit(".*"))).when(k == 3, "*").when(k == 4, "git+https://x/y").otherwise(F.concat(F.lit("~"), size, F.lit(".1")))
    return t("part").select("p_partkey", T.specifier_kind(text).alias("kind"))


@query("select page_id, regexp_extract(regexp_extract(url, '://([^?#]*)', 1), '([^/]*)$', 1) as name, lower(regexp_extract(regexp_extract(regexp_extract(url, '://([^?#]*)', 1), '([^/]*)$', 1), '^.+([.][^.]+)$', 1)) as extension, regexp_extract(regexp_extract(url, '://([^?#]*)', 1), '^(.*)/[^/]*$', 1) as directory from pages")
def file_classify(t) -> DataFrame:
    path = F.regexp_extract("url", "://([^?#]*)", 1)
    return t("pages").select("page_id", T.file_name(path).alias("name"), T.extension(path).alias("extension"), T.parent(path).alias("directory"))


@query("select event_type, cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by 1, 2")
def json_props(t) -> DataFrame:
    return t("events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_orderdate from orders where o_custkey = 77 order by o_orderdate desc, o_orderkey desc")
def history_desc(t) -> DataFrame:
    return t("orders").where("o_custkey = 77").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "o_orderdate")


@query(
    "with g as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 30 minute then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),"
    " s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from g) select user_id, cast(session as bigint) as session, count(*) as n_events, round(sum(value), 2) as value from s group by 1, 2"
)
def session_activity(t) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.col("ts") - F.lag("ts").over(by)) > F.expr("interval 30 minutes")
    events = t("events").withColumn("new", F.when(F.lag("ts").over(by).isNull() | gap, 1).otherwise(0)).withColumn("session", F.sum("new").over(by))
    return events.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("value"))
