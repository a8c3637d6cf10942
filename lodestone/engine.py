"""From a source tree to a sealed analysis, and questions to sealed ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans import evaluation, results, rules, views
from lodestone.sources import manifests, python_code, snapshot

ADVISORIES = "ecosystem string, package_name string, affected_version string, advisory_id string"


class Engine:
    """``store`` is a folder that driver and executors share."""

    #: The area that each detector belongs to.
    AREAS = {"high_degree": "architecture", "cycles": "architecture", "layer_violations": "architecture", "sizes": "architecture", "structure": "code_structure", "responsibilities": "architecture", "duplicates": "code_structure", "dependencies": "dependency", "security": "security", "authorization": "security", "secrets": "security"}

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")

    def _save(self, df: DataFrame) -> DataFrame:
        folder = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.getConf().get("spark.checkpoint.dir") or self.store
        path = f"{folder.rstrip('/')}/lodestone/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def analyze_tree(self, root: str, analysis_id: str, advisories: DataFrame | None = None) -> None:
        self.analyze(snapshot.read_tree(self.spark, root, analysis_id), advisories)

    def analyze(self, tree: DataFrame, advisories: DataFrame | None = None) -> None:
        """Analyses every snapshot in ``tree`` (analysis_id, path, content, size) and seals them."""
        if advisories is None:
            advisories = self.spark.createDataFrame([], ADVISORIES)
        files = snapshot.classified(tree)
        code = self._save(python_code.parsed(files))
        rows = self._save(manifests.read_manifests(files))
        deps = self._save(manifests.occurrences(rows))
        edges = self._save(rules.import_edges(code))
        detectors = {
            "high_degree": lambda: rules.high_degree(code, edges), "cycles": lambda: rules.cycles(edges), "layer_violations": lambda: rules.layer_violations(edges), "sizes": lambda: rules.sizes(code), "structure": lambda: rules.structure(code),
            "responsibilities": lambda: rules.responsibilities(code, edges), "duplicates": lambda: rules.duplicates(python_code.bodies(files)), "dependencies": lambda: rules.dependency_rules(deps, code, advisories),
            "security": lambda: rules.security_rules(code), "authorization": lambda: rules.authorization(code), "secrets": lambda: rules.hardcoded_secrets(files),
        }
        found, failed = evaluation.isolated(detectors, self._save)
        if not found:
            raise RuntimeError(f"every detector failed: {failed}")
        findings = self._save(results.merged(*found))
        states = results.domain_states(findings, files, code, rows)
        ids = states.select("analysis_id").distinct()
        broken = sorted({self.AREAS[d] for d in failed})
        if broken:  # what other detectors of the area have found stays
            weak = F.col("area").isin(*broken) & (F.col("state").isNull() | (F.col("state") == "No findings detected"))
            states = states.withColumn("state", F.when(weak, "Completed with limitations").otherwise(F.col("state")))
        states = self._save(states)
        how = F.create_map(*[F.lit(x) for d in detectors for x in (d, "Failed" if d in failed else "Evaluated")])
        evaluated = ids.select("*", F.explode(F.array(*[F.lit(d) for d in detectors])).alias("detector"))
        evaluated = evaluated.withColumn("state", how[F.col("detector")])
        tables = {"files": files.drop("content"), "code": code, "dependencies": deps, "edges": edges, "metrics": rules.graph_metrics(code, edges), "findings": findings, "states": states, "coverage": results.file_coverage(files, code), "outcomes": results.outcomes(states), "evaluations": evaluated}
        results.seal(self.spark, self.store, tables)

    def table(self, name: str, analysis_id: str) -> DataFrame:
        return results.load(self.spark, self.store, name, analysis_id)

    def findings(self, analysis_id: str, **how) -> tuple[DataFrame, int]:
        return results.select_findings(self.table("findings", analysis_id), **how)

    def architecture(self, analysis_id: str) -> tuple[DataFrame, DataFrame]:
        """Nodes with their figures and layer, and edges."""
        return self.table("metrics", analysis_id).withColumn("layer", rules.layer_of(F.col("path"))["layer"]), self.table("edges", analysis_id)

    def compare(self, base: str, target: str) -> DataFrame:
        return results.compare(self.table("findings", base), self.table("findings", target), self.table("states", target))

    def evaluations(self, analysis_id: str) -> DataFrame:
        """Whether each detector ran through or failed."""
        return self.table("evaluations", analysis_id)

    def tree(self, analysis_id: str) -> DataFrame:
        """Findings of every directory and file."""
        return results.tree(self.table("findings", analysis_id))

    def hotspots(self, analysis_id: str) -> DataFrame:
        return results.hotspots(self.table("findings", analysis_id))

    def counts(self, analysis_id: str) -> DataFrame:
        """Modules, imports and cycles."""
        cycles = self.table("findings", analysis_id).where("rule_id = 'ARCH-CIRCULAR-DEPENDENCY'")
        return views.graph_counts(self.table("metrics", analysis_id), self.table("edges", analysis_id).where("dst is not null"), cycles, ["analysis_id"])

    def result(self, analysis_id: str) -> str:
        return results.document(self.table("findings", analysis_id), self.table("states", analysis_id)).first()["document"]

    def report(self, analysis_id: str, form: str = "markdown") -> str:
        return self.result(analysis_id) if form == "json" else results.report(self.result(analysis_id), form)

    def history(self) -> DataFrame:
        return results.history(self.spark, self.store)

    def watch(self, requests: str, checkpoint: str):
        """Analyses every tree that a line of a text file in ``requests`` names: ``analysis_id<TAB>root``."""
        stream = self.spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).text(requests)

        def step(batch: DataFrame, _: int) -> None:
            for row in batch.selectExpr("split(value, '\t') as r").where("size(r) = 2").toLocalIterator():  # every request of the batch, one at a time
                done = results.sealed(self.spark, self.store)
                if done is None or done.where(done["analysis_id"] == row["r"][0]).isEmpty():  # a repeated batch does nothing
                    self.analyze_tree(row["r"][1], row["r"][0])

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
