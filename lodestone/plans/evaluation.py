"""What became of rules and areas: states, evaluations, limitations, stages, comparability."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import generic as G

# Coverage statuses by the rule state that they stand for
COVERED = ("covered", "supported")
PARTIAL = ("partially_covered", "partial")
SKIPPED = ("unsupported", "not_applicable")
FAILED = ("failed",)
STATES = {"Failed": FAILED, "Partially evaluated": PARTIAL, "Not evaluated": SKIPPED, "Evaluated": COVERED}
# The stages of an analysis, in their order, and its outcomes
STAGES = ("Queued", "ValidatingRepository", "ResolvingCommit", "RetrievingRepository", "IndexingFiles", "DetectingLanguages", "ParsingSource", "BuildingCodeModel", "RunningAnalysis", "AggregatingResults", "GeneratingReports")
OUTCOMES = ("Completed", "Completed with limitations", "Failed")
LIMITATION = ("scope_kind", "area", "rule_id", "path", "reason")


def unknown(what: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value.cast("string"), F.lit("null"))))


def rule_state(status: Column) -> Column:
    """The state of a rule by the status of its coverage; an unknown status is an error."""
    word = F.lower(F.trim(status))
    cases = reduce(lambda c, kv: c.when(word.isin(*kv[1]), F.lit(kv[0])), STATES.items(), F)
    return cases.otherwise(unknown("coverage status", status).cast("string"))


def evaluations(rules: DataFrame, coverage: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, rule_id, state, reason for every registered rule: a failure overrides coverage (``status``, ``reason``); without any it is not evaluated."""
    by = [*keys, "rule_id"]
    rows = rules.join(failures.select(*by, F.lit(True).alias("failed")).distinct(), by, "left").join(coverage.select(*by, "status", F.col("reason").alias("said")), by, "left")
    state = F.when(F.col("failed"), "Failed").when(F.col("status").isNull(), "Not evaluated").otherwise(rule_state(F.col("status")))
    reason = F.when(F.col("failed"), "The rule did not complete.").when(F.col("status").isNull(), "No coverage was reported for the rule.").otherwise(F.nullif("said", F.lit("")))
    return rows.select(*by, state.alias("state"), reason.alias("reason"))


def area_states(areas: DataFrame, coverage: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and state of each area (``analyzer_failed``, ``n_rule_failures``, ``limited``, ``n_findings``), by strict precedence; null means that findings speak."""
    status = F.lower(F.trim("status"))
    seen = coverage.groupBy(*keys).agg(F.bool_or(status.isin(*FAILED)).alias("failed"), F.bool_or(status.isin(*PARTIAL)).alias("partial"), F.bool_and(status.isin(*SKIPPED)).alias("skipped"))
    state = (
        F.when(F.col("analyzer_failed") | F.col("failed"), "Analysis failed")
        .when((F.col("n_rule_failures") > 0) | F.col("partial") | F.col("limited"), "Analysis incomplete")
        .when(F.col("skipped").isNull() | F.col("skipped"), "Analysis not performed")
        .when(F.col("n_findings") > 0, F.lit(None))
        .otherwise("No findings detected")
    )
    return areas.join(seen, keys, "left").select(*keys, state.alias("state"))


def limitation_scope(scope: Column, rule_id: Column, path: Column, areas: tuple[str, ...], others: tuple[str, ...] = ("index",)) -> Column:
    """Struct of scope_kind and area: ``area:what`` is about a rule, a file or the area, by what it names."""
    text = F.trim(scope)
    area = F.split(text, ":", 2)[0]
    named = lambda k: F.struct(F.lit(k).alias("scope_kind"), area.alias("area"))
    plain = lambda k: F.struct(k.alias("scope_kind"), F.lit(None).cast("string").alias("area"))
    wrong = F.struct(unknown("limitation scope", scope).cast("string").alias("scope_kind"), F.lit(None).cast("string").alias("area"))
    both = F.when(~area.isin(*areas), wrong).when(rule_id.isNotNull(), named("rule")).when(path.isNotNull(), named("file")).otherwise(named("area"))
    whole = F.when(rule_id.isNull() & path.isNull(), plain(text)).otherwise(wrong)
    return F.when(text == "analysis", whole).when(text.contains(":"), both).when(text.isin(*areas), named("area")).when(text.isin(*others), plain(text)).otherwise(wrong)


def limitations(*parts: DataFrame) -> DataFrame:
    """All limitations one behind the other, repeated ones too."""
    return reduce(DataFrame.unionByName, parts)


def limitation_order() -> list[Column]:
    """By scope, area, rule, path and reason, nothing before something."""
    return [F.coalesce(c, F.lit("")) for c in LIMITATION]


def by_scope(found: DataFrame, keys: list[str]) -> DataFrame:
    """How many limitations there are of each scope."""
    return found.groupBy(*keys, "scope_kind").agg(F.count("*").alias("n"))


def advisory_status(asked: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, status of a batch of look-ups (``failed``, ``n_found``): null if nothing was asked."""
    n, bad, got = F.count("failed"), F.count_if("failed"), F.coalesce(F.sum("n_found"), F.lit(0))
    status = F.when(n == 0, F.lit(None)).when(bad == 0, "succeeded").when((bad >= n) & (got == 0), "unavailable").otherwise("partly succeeded")
    return asked.groupBy(*keys).agg(status.alias("status"))


def origin_label(value: Column) -> Column:
    """Of a branch or commit; null stays null, an unknown word is an error."""
    word = F.lower(F.trim(value))
    return F.when(value.isNull(), F.lit(None)).when(word == "requested", "Requested").when(word == "defaulted", "Defaulted").otherwise(unknown("origin", value).cast("string"))


def advisory_label(value: Column) -> Column:
    """Of an advisory status; whatever is not known was not available."""
    word = F.lower(F.trim(value))
    return F.when(word == "succeeded", "Succeeded").when(word == "partly succeeded", "Partly succeeded").otherwise("Unavailable")


def stages(log: DataFrame, key: str, order: str) -> DataFrame:
    """Of a log of stages and outcomes (``key``, ``order``, ``word``) each analysis's last stage, its first outcome and how many entries came too late: an outcome is final."""
    word = F.col("word")
    known = F.when(word.isin(*STAGES, *OUTCOMES), word).otherwise(unknown("stage", word).cast("string"))
    rows = log.select(key, order, known.alias("word"), F.when(word.isin(*OUTCOMES), F.col(order)).alias("ended"))
    end = rows.groupBy(key).agg(F.min("ended").alias("end"))
    rows = rows.join(end, key)
    before = F.col("end").isNull() | (F.col(order) < F.col("end"))
    return rows.groupBy(key).agg(F.max_by("word", F.when(before, F.col(order))).alias("stage"), F.max(F.when(F.col(order) == F.col("end"), F.col("word"))).alias("outcome"), F.count_if(F.col(order) > F.col("end")).alias("too_late"))


def comparability(pairs: DataFrame) -> DataFrame:
    """``pairs`` (structs ``base`` and ``target`` of two snapshots) with comparable, reason and, by context, whether the two differ."""
    other, same = F.col("base.repository_id") != F.col("target.repository_id"), F.col("base.analysis_id") == F.col("target.analysis_id")
    reason = F.when(other, "Analyses belong to different repositories.").when(same, "Baseline and target are the same analysis.")
    differs = lambda *cs: ~reduce(lambda a, b: a & b, [F.col(f"base.{c}").eqNullSafe(F.col(f"target.{c}")) for c in cs])
    contexts = {"analyzer_version": ["analyzer_version"], "rule_set_version": ["rule_set_version"], "configuration": ["configuration"], "advisory_data": ["advisory_source", "advisory_status"]}
    return pairs.withColumn("comparable", reason.isNull()).withColumn("reason", reason).withColumns({f"other_{k}": F.when(F.col("comparable"), differs(*cs)) for k, cs in contexts.items()})


def new_rules(known: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """The rules of ``offered`` that ``known`` lacks; a known rule whose content has changed is an error."""
    content = [c for c in offered.columns if c not in keys]
    old = known.select(*keys, F.struct(*content).alias("old"))
    met = offered.join(old, keys, "left")
    changed = F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.struct(*content))
    checked = met.withColumn("old", F.when(changed, unknown("content of rule", F.concat_ws(" ", *keys)).cast(met.schema["old"].dataType.simpleString())).otherwise(F.col("old")))
    return checked.where("old is null").select(*offered.columns)


def with_rule_names(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """``findings`` with rule_name; a finding of an unregistered rule is an error."""
    met = findings.join(rules.select("rule_id", F.col("name").alias("rule_name")), "rule_id", "left")
    return met.withColumn("rule_name", F.coalesce("rule_name", unknown("rule", F.col("rule_id")).cast("string")))


def isolated(rules: dict[str, Callable[[], DataFrame]], save: Callable[[DataFrame], DataFrame]) -> tuple[list[DataFrame], dict[str, str]]:
    """Each rule's saved findings and, of those that failed, the kind of failure: one failing rule leaves the others alone."""
    found, failed = [], {}
    for name, rule in rules.items():
        try:
            found.append(save(rule()))
        except Exception as e:  # whatever a rule's plan or run raises is that rule's failure
            failed[name] = type(e).__name__
    return found, failed


def completeness(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, complete, and the sorted reasons of what is not (``complete``, ``reason``)."""
    return parts.groupBy(*keys).agg(F.bool_and("complete").alias("complete"), F.array_sort(F.collect_set(F.when(~F.col("complete"), F.col("reason")))).alias("reasons"))


def summary_of(found: DataFrame, keys: list[str], column: str, words: tuple[str, ...]) -> DataFrame:
    """A count of each word of a closed vocabulary, zero where there is none."""
    return found.groupBy(*keys).agg(*[F.count_if(F.col(column) == w).alias(w) for w in words])


def worst_of(df: DataFrame, keys: list[str], column: str, ranks: dict[str, int]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(column, G.rank_of(column, ranks)).alias(column))
