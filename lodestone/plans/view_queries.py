"""Evaluations and views on ordinary tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import source_text as S
from lodestone.operators import generic as G
from lodestone.plans import evaluation as E
from lodestone.plans import table_queries
from lodestone.plans import views as V

query = table_queries.query
WORDS = {"view": "covered", "click": "partial", "signup": "unsupported", "purchase": " Supported ", "error": "failed"}
WORDS_SQL = "case event_type when 'view' then 'covered' when 'click' then 'partial' when 'signup' then 'unsupported' when 'purchase' then ' Supported ' when 'error' then 'failed' end"


def _status(t) -> DataFrame:
    words = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    return t("events").select("event_id", "user_id", words[F.col("event_type")].alias("status"))


@query(f"with s as (select event_id, lower(trim({WORDS_SQL})) as w from events) select event_id, case w when 'failed' then 'Failed' when 'partial' then 'Partially evaluated' when 'unsupported' then 'Not evaluated' else 'Evaluated' end as state from s")
def rule_states(t) -> DataFrame:
    return _status(t).select("event_id", E.rule_state(F.col("status")).alias("state"))


@query(
    f"with l as (select user_id, max_by({WORDS_SQL}, event_id) as status from events group by 1), r as (select c_custkey as k from customer), f as (select distinct o_custkey as k from orders where o_orderstatus = 'P')"
    " select 'tables' as run, r.k as rule_id, case when f.k is not null then 'Failed' when status is null then 'Not evaluated' when status = 'failed' then 'Failed' when status = 'partial' then 'Partially evaluated' when status = 'unsupported' then 'Not evaluated' else 'Evaluated' end as state,"
    " case when f.k is not null then 'The rule did not complete.' when status is null then 'No coverage was reported for the rule.' when status = 'covered' then null else status end as reason from r left join f on r.k = f.k left join l on r.k = l.user_id"
)
def rule_evaluations(t) -> DataFrame:
    run = F.lit("tables").alias("run")
    coverage = _status(t).groupBy(F.col("user_id").alias("rule_id")).agg(F.max_by("status", "event_id").alias("status")).select(run, "rule_id", "status", F.when(F.col("status") == "covered", "").otherwise(F.col("status")).alias("reason"))
    return E.evaluations(t("customer").select(run, F.col("c_custkey").alias("rule_id")), coverage, t("orders").where("o_orderstatus = 'P'").select(run, F.col("o_custkey").alias("rule_id")), ["run"])


@query(
    f"with c as (select user_id, bool_or(w = 'failed') as failed, bool_or(w = 'partial') as partial, bool_and(w = 'unsupported') as skipped from (select user_id, lower(trim({WORDS_SQL})) as w from events where value > 95) group by 1),"
    " a as (select c_custkey as area, c_acctbal < -900 as broken, c_nationkey = 3 as limited, c_custkey % 4 as n from customer)"
    " select area, case when broken or failed then 'Analysis failed' when n = 3 and limited or partial or limited then 'Analysis incomplete' when skipped is null or skipped then 'Analysis not performed' when n > 0 then null else 'No findings detected' end as state from a left join c on area = user_id"
)
def area_states(t) -> DataFrame:
    areas = t("customer").select(F.col("c_custkey").alias("area"), (F.col("c_acctbal") < -900).alias("analyzer_failed"), (F.col("c_nationkey") == 3).alias("limited"), F.when((F.col("c_nationkey") == 3) & (F.col("c_custkey") % 4 == 3), 1).otherwise(0).alias("n_rule_failures"), (F.col("c_custkey") % 4).alias("n_findings"))
    words = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    coverage = t("events").where("value > 95").select(F.col("user_id").alias("area"), words[F.col("event_type")].alias("status"))
    return E.area_states(areas, coverage, ["area"])


@query(
    "select p_partkey, case p_size % 5 when 0 then 'analysis' when 1 then case when p_partkey % 2 = 0 then 'rule' else 'file' end when 2 then 'area' when 3 then 'index' else 'area' end as scope_kind, case p_size % 5 when 1 then 'security' when 2 then 'dependency' when 4 then 'architecture' end as area from part"
)
def limitation_scopes(t) -> DataFrame:
    k = F.col("p_size") % 5
    scope = F.when(k == 0, " analysis").when(k == 1, "security:calls").when(k == 2, "dependency").when(k == 3, "index").otherwise("architecture:all ")
    rule, path = F.when((k == 1) & (F.col("p_partkey") % 2 == 0), F.lit("SEC")), F.when(k == 1, F.col("p_name"))
    return t("part").select("p_partkey", E.limitation_scope(scope, rule, path, ("security", "dependency", "architecture", "code_structure")).alias("s")).select("p_partkey", "s.*")


@query("select c_nationkey as run, scope_kind, count(*) as n from (select c_nationkey, case when c_acctbal < 0 then 'rule' else c_mktsegment end as scope_kind from customer union all select s_nationkey, 'file' from supplier) group by 1, 2")
def limitations_by_scope(t) -> DataFrame:
    own = t("customer").select(F.col("c_nationkey").alias("run"), F.when(F.col("c_acctbal") < 0, "rule").otherwise(F.col("c_mktsegment")).alias("scope_kind"))
    return E.by_scope(E.limitations(own, t("supplier").select(F.col("s_nationkey").alias("run"), F.lit("file").alias("scope_kind"))), ["run"])


@query(
    "with q as (select c_custkey, o_orderkey, o_orderstatus <> 'F' as failed, case when o_orderstatus = 'O' and o_totalprice > 400000 then 1 else 0 end as n from customer left join orders on o_custkey = c_custkey)"
    " select c_custkey, case when count(failed) = 0 then null when count(*) filter (failed) = 0 then 'succeeded' when count(*) filter (failed) >= count(failed) and coalesce(sum(n) filter (o_orderkey is not null), 0) = 0 then 'unavailable' else 'partly succeeded' end as status from q group by 1"
)
def advisory_statuses(t) -> DataFrame:
    asked = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", (F.col("o_orderstatus") != "F").alias("failed"), F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 400000), 1).otherwise(0).alias("n_found"))
    return E.advisory_status(asked, ["c_custkey"])


@query("select p_partkey, case p_size % 3 when 0 then 'Requested' when 1 then 'Defaulted' end as origin, case p_size % 4 when 0 then 'Succeeded' when 1 then 'Partly succeeded' else 'Unavailable' end as advisory from part")
def status_labels(t) -> DataFrame:
    size = F.col("p_size")
    return t("part").select("p_partkey", E.origin_label(F.when(size % 3 == 0, " Requested").when(size % 3 == 1, "DEFAULTED")).alias("origin"), E.advisory_label(F.when(size % 4 == 0, "succeeded").when(size % 4 == 1, "Partly Succeeded").when(size % 4 == 2, "odd")).alias("advisory"))


@query(
    "with l as (select user_id, event_id, case event_type when 'view' then 'ParsingSource' when 'click' then 'IndexingFiles' when 'signup' then 'Queued' when 'purchase' then 'RunningAnalysis' else case when value > 90 then 'Failed' else 'AggregatingResults' end end as word from events),"
    " e as (select user_id, min(event_id) filter (word = 'Failed') as stop from l group by 1) select l.user_id, max_by(word, event_id) filter (stop is null or event_id < stop) as stage, max(word) filter (event_id = stop) as outcome, count(*) filter (event_id > stop) as too_late from l join e using (user_id) group by 1"
)
def stage_log(t) -> DataFrame:
    kind = F.col("event_type")
    word = F.when(kind == "view", "ParsingSource").when(kind == "click", "IndexingFiles").when(kind == "signup", "Queued").when(kind == "purchase", "RunningAnalysis").when(F.col("value") > 90, "Failed").otherwise("AggregatingResults")
    return E.stages(t("events").select("user_id", "event_id", word.alias("word")), "user_id", "event_id")


@query(
    "select a.c_custkey as base_id, b.c_custkey as target_id, a.c_nationkey = b.c_nationkey as comparable, case when a.c_nationkey <> b.c_nationkey then 'Analyses belong to different repositories.' end as reason,"
    " case when a.c_nationkey = b.c_nationkey then a.c_mktsegment <> b.c_mktsegment end as other_analyzer_version, case when a.c_nationkey = b.c_nationkey then (a.c_acctbal > 0) <> (b.c_acctbal > 0) end as other_advisory_data from customer a join customer b on b.c_custkey = a.c_custkey + 1"
)
def comparable_runs(t) -> DataFrame:
    def view(c):
        return F.struct(F.col("c_custkey").alias("analysis_id"), F.col("c_nationkey").alias("repository_id"), F.col("c_mktsegment").alias("analyzer_version"), F.lit(1).alias("rule_set_version"), F.lit("x").alias("configuration"), F.lit(None).cast("string").alias("advisory_source"), (F.col("c_acctbal") > 0).alias("advisory_status")).alias(c)

    c = t("customer")
    pairs = c.select("c_custkey", view("base")).join(c.select((F.col("c_custkey") - 1).alias("c_custkey"), view("target")), "c_custkey")
    return E.comparability(pairs).select(F.col("base.analysis_id").alias("base_id"), F.col("target.analysis_id").alias("target_id"), "comparable", "reason", "other_analyzer_version", "other_advisory_data")


@query("select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity = 1)")
def new_rules(t) -> DataFrame:
    parts = t("part").select("p_partkey", "p_name")
    known = parts.join(t("lineitem").where("l_quantity = 1").select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_semi")
    return E.new_rules(known, parts, ["p_partkey"])


@query("select o_orderkey as finding_id, c_name as rule_name from orders join customer on c_custkey = o_custkey")
def finding_rule_names(t) -> DataFrame:
    found = t("orders").select(F.col("o_orderkey").alias("finding_id"), F.col("o_custkey").alias("rule_id"))
    return E.with_rule_names(found, t("customer").select(F.col("c_custkey").alias("rule_id"), F.col("c_name").alias("name"))).select("finding_id", "rule_name")


@query("select l_suppkey as run, bool_and(l_tax < 0.08) as complete, coalesce(string_agg(distinct l_returnflag, ',' order by l_returnflag) filter (l_tax >= 0.08), '') as reasons from lineitem group by 1")
def completeness(t) -> DataFrame:
    parts = t("lineitem").select(F.col("l_suppkey").alias("run"), (F.col("l_tax") < 0.08).alias("complete"), F.col("l_returnflag").alias("reason"))
    return E.completeness(parts, ["run"]).withColumn("reasons", F.array_join("reasons", ","))


@query("select source, count(*) filter (lang = 'en') as en, count(*) filter (lang = 'fr') as fr, count(*) filter (lang = 'zz') as zz from documents group by 1")
def parse_summary(t) -> DataFrame:
    return E.summary_of(t("documents"), ["source"], "lang", ("en", "fr", "zz"))


FILES_SQL = "with f as (select d.doc_id, source || '/' || d.doc_id as path, d.lang as language, coalesce(toxic, 0) as n_findings, case when n_chars < 100 then 'Not analyzed' else 'Fully analyzed' end as state, case when n_chars > 5000 then 'partial' else 'ok' end as parse from documents d left join (select doc_id, max(toxic) as toxic from labels group by 1) l using (doc_id))"


def _files(t) -> DataFrame:
    toxic = t("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return t("documents").join(toxic, "doc_id", "left").select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("lang").alias("language"), F.coalesce("toxic", F.lit(0)).alias("n_findings"), F.when(F.col("n_chars") < 100, "Not analyzed").otherwise("Fully analyzed").alias("state"), F.when(F.col("n_chars") > 5000, "partial").otherwise("ok").alias("parse"))


@query(FILES_SQL + " select doc_id, 'found' as why from f where contains(lower(path), '/1') and n_findings > 0 union all select doc_id, 'language' from f where language = 'en' and state = 'Not analyzed' union all select doc_id, 'parse' from f where parse = 'partial'")
def file_filters(t) -> DataFrame:
    files, why = _files(t), lambda df, w: df.select("doc_id", F.lit(w).alias("why"))
    return why(V.select_files(files, "/1", with_findings=True), "found").union(why(V.select_files(files, language="en", not_analyzed=True), "language")).union(why(V.select_files(files, parse_issue=True), "parse"))


DEPS_SQL = "with d as (select l_orderkey * 10 + l_linenumber as id, 'lib' || l_partkey as name, cast(l_suppkey % 3 as varchar) as version, case when l_linenumber = 1 then 'direct' else 'transitive' end as dependency_class, case when l_quantity > 49 then 1 else 0 end as n_advisories, l_suppkey as run from lineitem)"


def _deps(t) -> DataFrame:
    return t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("lib"), "l_partkey").alias("name"), (F.col("l_suppkey") % 3).cast("string").alias("version"), F.when(F.col("l_linenumber") == 1, "direct").otherwise("transitive").alias("dependency_class"), F.when(F.col("l_quantity") > 49, 1).otherwise(0).alias("n_advisories"), F.col("l_suppkey").alias("run"))


@query(DEPS_SQL + " select id, 'direct' as why from d where dependency_class = 'direct' and contains(name, '77') union all select id, 'vulnerable' from d where n_advisories > 0 union all select id, 'duplicate' from d where name in (select name from d group by 1 having count(distinct version) > 1) and contains(name, 'b5')")
def dependency_filters(t) -> DataFrame:
    deps, why = _deps(t), lambda df, w: df.select("id", F.lit(w).alias("why"))
    return why(V.select_dependencies(deps, "direct", "77"), "direct").union(why(V.select_dependencies(deps, "vulnerable"), "vulnerable")).union(why(V.select_dependencies(deps, "duplicate", "B5"), "duplicate"))


@query(DEPS_SQL + ", v as (select run, name, count(distinct version) > 1 as several from d group by 1, 2), s as (select run, count(*) filter (several) as duplicate from v group by 1) select run, count(*) as total, count(*) filter (dependency_class = 'direct') as direct, count(*) filter (dependency_class = 'transitive') as transitive, count(*) filter (n_advisories > 0) as vulnerable, any_value(duplicate) as duplicate from d join s using (run) group by 1")
def dependency_counts(t) -> DataFrame:
    return V.dependency_counts(_deps(t), ["run"])


@query("with n as (select s_suppkey as id, s_name as node, s_nationkey as layer from supplier where s_acctbal > 0) select distinct a.node as src, b.node as dst from lineitem join n a on a.id = l_suppkey join n b on b.id = l_partkey where a.layer < 12 and b.layer < 12")
def graph_filter(t) -> DataFrame:
    nodes = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("node"), F.col("s_nationkey").alias("layer"))
    edges = V.named_ends(t("lineitem").select(F.col("l_suppkey").alias("src_id"), F.col("l_partkey").alias("dst_id")).distinct(), nodes)
    return V.subgraph(nodes, edges, members=nodes.where("layer < 12").select("node"))[1].select("src", "dst").distinct()


@query("with e as (select distinct l_suppkey % 40 as src, l_partkey % 40 as dst from lineitem where l_linenumber < 3) select (select string_agg(dst, ',' order by dst) from e where src = 7) as outgoing, (select string_agg(src, ',' order by src) from e where dst = 7) as incoming, (select string_agg(s_suppkey, ',' order by s_suppkey) from supplier where s_suppkey % 40 = 7) as findings")
def module_detail(t) -> DataFrame:
    edges = t("lineitem").where("l_linenumber < 3").select((F.col("l_suppkey") % 40).alias("src"), (F.col("l_partkey") % 40).alias("dst"))
    detail = V.node_detail(edges, t("supplier").select((F.col("s_suppkey") % 40).alias("path"), F.col("s_suppkey").alias("finding_id")), F.lit(7))
    return detail.select(*[F.nullif(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("")).alias(c) for c in detail.columns])


@query("select p_partkey, (select min(l_orderkey) from lineitem where l_partkey = p_partkey and l_quantity = p_size) as finding_id from part")
def metric_first_finding(t) -> DataFrame:
    metrics = t("part").select("p_partkey", F.col("p_size").cast("double").alias("metric"), F.col("p_partkey").alias("path"))
    found = t("lineitem").select(F.col("l_quantity").alias("metric"), F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("finding_id"))
    return V.first_finding(metrics, found).select("p_partkey", "finding_id")


@query("select l_suppkey as path, count(distinct l_orderkey) as n from lineitem group by 1")
def findings_per_file(t) -> DataFrame:
    return V.files_of_findings(t("lineitem").select(F.col("l_orderkey").alias("finding_id"), F.col("l_suppkey").alias("path")))


@query("select o_custkey as dependency_id, o_orderkey as finding_id, o_orderstatus as state from orders")
def dependency_findings(t) -> DataFrame:
    deps = t("orders").groupBy(F.col("o_custkey").alias("dependency_id")).agg(F.collect_list("o_orderkey").alias("finding_ids"))
    return V.findings_of_dependencies(deps, t("orders").select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderstatus").alias("state")))


@query("with f as (select p_partkey as finding_id, case when p_partkey % 2 = 0 then cast(p_partkey % 3 as varchar) end as wanted from part) select finding_id, l_orderkey * 10 + l_linenumber as dependency_id from f join lineitem on l_partkey = finding_id where wanted is null or wanted = cast(l_suppkey % 3 as varchar)")
def dependency_links(t) -> DataFrame:
    key = F.col("p_partkey")
    found = t("part").select(key.alias("finding_id"), F.concat_ws(":", F.lit("PyPI"), F.concat(F.lit("lib"), key), F.when(key % 2 == 0, (key % 3).cast("string"))).alias("subject"))
    return V.dependency_links(found, _deps(t).select(F.lit("PyPI").alias("ecosystem"), "name", "version", F.col("id").alias("dependency_id")))


@query("select o_orderkey as finding_id, c_custkey as module_id from orders join customer on c_custkey in (o_custkey, o_custkey + 1, o_orderkey % 50)")
def module_links(t) -> DataFrame:
    found = t("orders").select(F.col("o_orderkey").alias("finding_id"), F.concat_ws(",", "o_custkey", F.col("o_custkey") + 1, F.col("o_orderkey") % 50).alias("subject"))
    return V.module_links(found, t("customer").select(F.col("c_custkey").alias("module_id"), F.col("c_custkey").cast("string").alias("path")))


@query("with d as (select distinct l_partkey as name, cast(l_suppkey % 3 as varchar) as version from lineitem), r as (select o_orderkey as parent, o_custkey as child, case when o_orderstatus <> 'P' then cast(o_orderkey % 3 as varchar) end as cv from orders) select d.name, version, coalesce(string_agg(distinct parent, ',' order by parent), '') as parents from d left join r on child = d.name and (cv is null or cv = version) group by 1, 2")
def introducing_parents(t) -> DataFrame:
    deps = t("lineitem").select(F.col("l_partkey").alias("name"), (F.col("l_suppkey") % 3).cast("string").alias("version"))
    relations = t("orders").select(F.col("o_orderkey").alias("parent"), F.col("o_custkey").alias("child"), F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 3).cast("string")).alias("child_version"))
    found = V.introducers(deps, relations.withColumn("parent", F.col("parent").cast("string")))
    return found.withColumn("parents", F.array_join(F.array_sort(F.col("parents").cast("array<long>")), ","))


@query("select kind, src, count(*) as n from (select l_suppkey as src, 'import' as kind from lineitem where l_linenumber = 1 union all select l_suppkey, 'call' from lineitem where l_linenumber > 4) group by 1, 2")
def relationships(t) -> DataFrame:
    ends = t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    return V.relationships(ends.where("l_linenumber = 1"), ends.where("l_linenumber > 4")).groupBy("kind", "src").agg(F.count("*").alias("n"))


@query("select n_regionkey as run, count(*) as modules, coalesce(any_value(imports), 0) as imports, coalesce(any_value(cycles), 0) as cycles from nation left join (select n_regionkey as r, count(distinct (c_custkey, c_mktsegment)) as imports from customer join nation on n_nationkey = c_nationkey group by 1) on r = n_regionkey left join (select s_nationkey % 5 as q, count(*) as cycles from supplier where s_acctbal > 9000 group by 1) on q = n_regionkey group by 1")
def graph_counts(t) -> DataFrame:
    edges = t("customer").join(F.broadcast(t("nation")), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_regionkey").alias("run"), F.col("c_custkey").alias("src"), F.col("c_mktsegment").alias("dst"))
    return V.graph_counts(t("nation").select(F.col("n_regionkey").alias("run")), edges, t("supplier").where("s_acctbal > 9000").select((F.col("s_nationkey") % 5).alias("run")), ["run"])


@query("with m as (select s_suppkey as node, s_suppkey % 10 as component, s_nationkey as package from supplier), e as (select distinct l_suppkey as src, l_partkey as dst from lineitem), i as (select a.component, count(*) as n_edges from e join m a on a.node = src join m b on b.node = dst where a.component = b.component group by 1) select 'tables' as run, component, count(*) as n_members, min(package) <> max(package) as crosses, any_value(n_edges) as n_edges from m join i using (component) group by 2")
def cycle_groups(t) -> DataFrame:
    run = F.lit("tables").alias("run")
    members = t("supplier").select(run, F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 10).alias("component"), F.col("s_nationkey").alias("package"))
    return V.cycle_groups(t("lineitem").select(run, F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), members, ["run"], F.col("package"))


@query("with p as (select regexp_extract(url, '://([^?#]*)', 1) as path, length(html) as size, page_id % 7 as run from pages) select run, count(*) as n_files, cast(sum(size) as bigint) as n_bytes, max(len(string_split(path, '/')) - 1) as depth from p group by 1")
def tree_totals(t) -> DataFrame:
    files = t("pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"), F.char_length("html").cast("long").alias("size"), (F.col("page_id") % 7).alias("run"))
    return V.totals(files, ["run"])


@query("select l_partkey as name, l_suppkey as subject, min(l_orderkey * 10 + l_linenumber) as first from lineitem group by 1, 2")
def metric_dedupe(t) -> DataFrame:
    metrics = t("lineitem").select(F.col("l_partkey").alias("name"), F.lit("k").alias("kind"), F.lit("p").alias("path"), F.col("l_suppkey").alias("subject"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))
    return V.first_metric(metrics, [F.col("first")]).select("name", "subject", "first")


@query("select l_orderkey, l_linenumber as line from (select *, row_number() over (partition by l_orderkey order by l_returnflag = 'R' desc, l_linenumber) as n from lineitem) where n = 1")
def first_sink(t) -> DataFrame:
    sinks = t("lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("is_write"), F.col("l_linenumber").alias("line"), F.lit(0).alias("column"))
    return V.first_sink(sinks, ["l_orderkey"]).select("l_orderkey", "line")


@query("with n as (select o_custkey, list(o_orderkey order by o_orderkey) as k from orders group by 1) select o_custkey, array_to_string(k[1:5], ', ') || case when len(k) > 5 then ' +' || (len(k) - 5) || ' more' else '' end as shown from n")
def display_caps(t) -> DataFrame:
    names = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>").alias("names"))
    return names.select("o_custkey", V.shown(F.col("names"), 5).alias("shown"))


@query("select l_orderkey, string_agg(l_linenumber, ',' order by l_returnflag <> 'R', l_suppkey, l_linenumber) as places from lineitem group by 1")
def location_order(t) -> DataFrame:
    place = F.struct((F.col("l_returnflag") == "R").alias("primary"), F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("line"), F.lit(0).alias("column"))
    found = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(place).alias("places"))
    return found.select("l_orderkey", F.array_join(F.transform(V.locations_in_order(F.col("places")), lambda p: p["line"].cast("string")), ",").alias("places"))


@query("select p_partkey as path, case when p_size > 40 then null else p_size end as value from part order by case when p_size > 40 then null else p_size end desc nulls last, p_partkey limit 200")
def metric_table(t) -> DataFrame:
    rows = t("part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") <= 40, F.col("p_size")).alias("value"))
    return G.page(rows, V.metric_order("value", True), 1, 200)


@query(
    "select p_partkey, case when p_size % 4 = 0 then 'own' || p_size end as owner, case when p_size % 4 = 0 then 'repo.' || p_partkey end as name, p_size % 3 = 0 as branch_ok, case when p_size % 2 = 0 then substr(md5(cast(p_partkey as varchar)), 1, 12) end as sha from part"
)
def repository_names(t) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    path = F.concat(F.lit("/Own"), size, F.lit("/Repo."), k)
    url = F.when(size % 4 == 0, F.concat(F.lit(" HTTPS://GitHub.com"), path, F.lit(".git/"))).when(size % 4 == 1, F.concat(F.lit("http://github.com"), path)).when(size % 4 == 2, F.concat(F.lit("https://u@github.com"), path)).otherwise(F.concat(F.lit("https://github.com"), path, F.lit("?x=1")))
    branch = F.when(size % 3 == 0, F.concat(F.lit("feature/x-"), k)).when(size % 3 == 1, F.concat("p_name", F.lit(" x.lock"))).otherwise("a..b")
    sha = F.when(size % 2 == 0, F.upper(F.substring(F.md5(k.cast("string")), 1, 12))).otherwise("nothex1")
    return t("part").select("p_partkey", V.repository(url).alias("r"), V.branch_is_valid(branch).alias("branch_ok"), V.commit(sha).alias("sha")).select("p_partkey", "r.owner", "r.name", "branch_ok", "sha")


@query("select event_id, case when event_type <> 'view' then 'ADV-' || event_id end as advisory_id, case when event_type <> 'view' then event_type || ',x' end as aliases, case when event_type = 'error' then 'HIGH' when event_type <> 'view' then '7.5' end as severity from events")
def advisory_records(t) -> DataFrame:
    kind = F.col("event_type")
    raw = F.concat(F.lit('{"id": "'), F.when(kind != "view", F.concat(F.lit("ADV-"), "event_id")).otherwise(""), F.lit('", "aliases": ["x", "'), kind, F.lit('", "x", null], "severity": [{"type": "s", "score": "7.5"}], "database_specific": {"severity": "'), F.when(kind == "error", "HIGH").otherwise(""), F.lit('"}, "references": [{"url": "u"}]}'))
    a = t("events").select("event_id", V.advisory(raw).alias("a"))
    return a.select("event_id", "a.advisory_id", F.array_join("a.aliases", ",").alias("aliases"), "a.severity")


@query(
    "with l as (select p_partkey as k, 'x' || p_partkey || ' = ' as head, 'f\"a#' || p_partkey || chr(92) || '\"(\"' as first, chr(39) || 'it, ' || p_size || chr(39) as second from part)"
    " select k, head || 'f\"\" + ' || repeat(chr(39), 2) || ' # it' as emptied, head || repeat(' ', len(first)) || ' + ' || repeat(' ', len(second) + 5) as blank, head || first || ' + ' || second || ' ' as line from l"
)
def source_masking(t) -> DataFrame:
    line = F.concat(F.lit("x"), "k", F.lit(' = f"a#'), "k", F.lit("\\\"(\" + 'it, "), "p_size", F.lit("' # it"))
    lines = G.dealt(t("part").select(F.col("p_partkey").alias("k"), "p_size"), "k").withColumn("text", line)
    return lines.select("k", S.strings_emptied(F.col("text")).alias("emptied"), S.blanked(F.col("text")).alias("blank"), S.without_comment(F.col("text")).alias("line"))


@query(
    "select p_partkey as k, 'open(p' || p_partkey || ', \"a,(' || p_size || '\", # one, (two' || chr(10) || '  g(1, [2, 3]), mode=(4, ))' as span,"
    " 'p' || p_partkey || ' | \"a,(' || p_size || '\" | # one, (two' || chr(10) || '  g(1, [2, 3]) | mode=(4, )' as arguments from part"
)
def call_arguments(t) -> DataFrame:
    lines = F.array(F.lit("# ("), F.concat(F.lit("y = open(p"), "k", F.lit(', "a,('), "p_size", F.lit('", # one, (two')), F.lit("  g(1, [2, 3]), mode=(4, )).read(1)"), F.lit("z"))
    calls = G.dealt(t("part").select(F.col("p_partkey").alias("k"), "p_size"), "k").select("k", S.call_span(lines, F.lit(2), F.lit(4)).alias("span"))
    return calls.select("k", "span", F.array_join(S.arguments(F.col("span")), " | ").alias("arguments"))


@query(
    "with s as (select o_custkey as k, o_orderstatus || o_orderpriority as w, row_number() over (partition by o_custkey order by o_orderkey) as i from orders),"
    " h as (select a.k, a.i, a.i - b.i as d from s a join s b on b.k = a.k + 1 and a.w = b.w),"
    " r as (select k, d, count(*) as n from (select k, d, i - row_number() over (partition by k, d order by i) as island from h) group by k, d, island),"
    " c as (select distinct a.k from s a join s b on b.k = a.k + 1)"
    " select c.k, cast(coalesce(max(n), 0) as int) as longest from c left join r on c.k = r.k group by c.k"
)
def shared_runs(t) -> DataFrame:
    words = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat("o_orderstatus", "o_orderpriority").alias("w")))), lambda x: x["w"])
    lists = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(words.alias("tokens"))
    both = lists.join(lists.select((F.col("k") - 1).alias("k"), F.col("tokens").alias("others")), "k")
    return both.select("k", S.longest_shared_run(F.col("tokens"), F.col("others")).alias("longest"))


@query("select l_orderkey as file, l_linenumber, 'f' || o_custkey as path from lineitem join orders on o_orderkey = l_orderkey")
def coverage_of_files(t) -> DataFrame:
    files = t("orders").select(F.col("o_orderkey").alias("file"), F.concat(F.lit("f"), "o_custkey").alias("path"))
    return V.coverage_of_files(files, t("lineitem").select(F.col("l_orderkey").alias("file"), "l_linenumber"), "file")
