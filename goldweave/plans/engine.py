"""The engine: two tables, or more that arrive later, to one master with lineage."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.functions.text import normalize_text
from goldweave.operators import adjudicate, blocking, commit, evaluation, feature_model, features, golden, graph, prepare, review, scoring
from goldweave.plans import profile as schema
from goldweave.sources.store import Change, Store
from goldweave.sources.tables import latest_run, master_scan, read_header, write_report


class SchemaMismatch(ValueError):
    """The tables describe different kinds of entities."""


@dataclass
class Run:
    run_id: str
    status: str
    profile: schema.SchemaProfile | None
    auto: DataFrame
    pending: DataFrame
    low: dict = field(default_factory=dict)
    #: Whether the features had to be fitted anew, because the bundle's could not be read.
    refitted: bool = False


Resolver = Callable[[DataFrame], DataFrame]
#: Columns of the engine's tables.
SCHEMAS = {
    "entities": "entity_id string, canonical_title string, manufacturer string, price double, status string, selected_source_table string, confidence double, attributes map<string,string>",
    "golden": "entity_id string, title string, manufacturer string, price double, selected_source_table string, source_payload string, source string, confidence double",
    "links": "entity_id string, source_table string, source_id string, title string, manufacturer string, price double, attributes map<string,string>",
    "aliases": "entity_id string, alias_title string, normalized_title string, source_table string, source_id string",
    "decisions": "run_id string, cluster_id string, left_id string, right_id string, decision string, confidence double, reason string, model_scores string",
    "log": "operation string, payload string",
    "waiting": "run_id string, cluster_id string, cluster_seq int, node_id string, source_table string, source_id string, title string, manufacturer string, price string, max_confidence double, attributes map<string,string>",
    "runs": "run_id string, payload string, updated_at double",
    "tasks": "task_id string, position long, status string, confidence double, l_id string, r_id string, l_title string, r_title string, l_maker string, r_maker string, l_price string, r_price string, "
    "l_manufacturer string, r_manufacturer string, l_attributes map<string,string>, r_attributes map<string,string>",
    "sources": "snapshot string, source_table string, source_id string, title string, manufacturer string, price string, attributes map<string,string>",
    "snapshots": "snapshot string, source_table string, rows long",
    "term_counts": f"epoch string, {features.COUNTS}",
    "term_volumes": f"epoch string, {features.VOLUMES}",
}
#: Keys by whose hashes the rows of a table lie in buckets; a change of the table rewrites the touched ones only.
KEYS = {"entities": ["entity_id"], "golden": ["entity_id"], "aliases": ["entity_id"], "links": ["source_table", "source_id"]}
MASTER_SPECS = [("title", "title"), ("manufacturer", "manufacturer"), ("price", "price")]


class Engine:
    """Master tables below ``root``.  ``most_postings`` bounds the pairs of one token where tables are large."""

    def __init__(self, spark: SparkSession, root: str, *, most_postings: int | None = None) -> None:
        self.spark, self.store, self.most_postings = spark, Store(spark, root), most_postings

    # ---- tables ------------------------------------------------------------------

    def table(self, name: str, like: DataFrame | None = None) -> DataFrame:
        """A table in its columns, those that an older master lacks as nulls; with ``like`` only the buckets of its keys."""
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        found = self.store.read(name, like)
        return empty if found is None else found.unionByName(empty, allowMissingColumns=True).select(*empty.columns) if set(empty.columns) - set(found.columns) else found

    def status(self) -> dict:
        tables = self.store.manifest()["tables"]
        return {name: tables.get(name, {}).get("changed", 0) for name in SCHEMAS}

    def _rows(self, name: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), SCHEMAS[name])

    def _append(self, name: str, rows: DataFrame) -> None:
        change = self.store.change()
        change.append(name, self._shaped(name, rows))
        change.commit()

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        return empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns)

    def _log(self, operation: str, payload: dict) -> None:
        self._append("log", self._rows("log", (operation, json.dumps(payload))))

    def _stage(self, change: Change, candidates: DataFrame, run_id: str, specs: list[tuple[str, str]] | None) -> None:
        """The changes of the candidates in all six master tables."""
        candidates = graph.settled(candidates)
        links = self.table("links", commit.source_refs(candidates))
        for name, df in commit.changes(links, candidates, specs=specs, run_id=run_id).items():
            df = self._shaped(name, df)
            if name in commit.UPSERT_KEYS:
                change.upsert(name, graph.settled(df), commit.UPSERT_KEYS[name], keys=KEYS[name])
            elif name in commit.INSERT_KEYS:
                change.insert(name, graph.settled(df), commit.INSERT_KEYS[name], keys=KEYS[name])
            else:
                change.append(name, df)

    def _write(self, candidates: DataFrame, run_id: str, specs: list[tuple[str, str]] | None = None) -> None:
        """Candidates to master rows; all tables change at once."""
        change = self.store.change()
        self._stage(change, candidates, run_id, specs)
        change.commit()

    # ---- statistics of titles ------------------------------------------------------

    def _count_titles(self, change: Change, epoch: str, *tables: DataFrame) -> None:
        """Add the counts of the tables' titles under ``epoch``; an epoch that is there already changes nothing."""
        if not self.table("term_volumes").where(F.col("epoch") == epoch).isEmpty():
            return
        for i, records in enumerate(tables):
            change.append("term_counts", self._shaped("term_counts", features.title_counts(records).withColumn("epoch", F.lit(epoch))))
            change.append("term_volumes", self._shaped("term_volumes", features.title_volumes(records).withColumn("epoch", F.lit(epoch))))

    def title_statistics(self, *more: DataFrame) -> features.FeatureBuilder:
        """The statistics of all titles that have arrived, and of ``more``: sums of the batches' counts, never counted anew on the master."""
        counts, volumes = self.table("term_counts").drop("epoch"), self.table("term_volumes").drop("epoch")
        for records in more:
            counts, volumes = counts.unionByName(features.title_counts(records)), volumes.unionByName(features.title_volumes(records))
        return features.FeatureBuilder(counts, volumes)

    def maintain(self) -> list[str]:
        """Sum up the batches' counts, compact tables of many folders, and delete what no recent manifest names."""
        if (self.store.read("term_volumes") is not None) and self.table("term_volumes").count() > 16:
            self.store.write("term_counts", self.table("term_counts").groupBy("kind", "term").agg(F.sum("df").alias("df")).select(F.lit(None).cast("string").alias("epoch"), "kind", "term", "df"))
        return self.store.maintain()

    # ---- runs --------------------------------------------------------------------

    def _save_run(self, run_id: str, payload: dict) -> None:
        self._append("runs", self._rows("runs", (run_id, json.dumps(payload), time.time())))

    def run_document(self, run_id: object = None) -> dict:
        """The last state of a run by its id, a payload or JSON text that names it, or of the latest run."""
        if isinstance(run_id, str) and run_id.lstrip().startswith("{"):
            run_id = json.loads(run_id)
        if isinstance(run_id, dict):
            run_id = run_id.get("match_run_id") or run_id.get("run_id")
        runs = self.table("runs") if run_id is None else self.table("runs").where(F.col("run_id") == str(run_id))
        found = latest_run(runs).first()
        if found is None:
            raise KeyError(f"no run {run_id}")
        return {"run_id": found["run_id"], **json.loads(found["payload"])}

    # ---- schema ------------------------------------------------------------------

    def validate(self, a: DataFrame, b: DataFrame | None = None) -> dict:
        if b is None:
            errors = prepare.missing_columns(prepare.rename_aliases(a))
            return {"valid": not errors, "errors": errors, "columns": a.columns}
        found = self.analyze_schema(a, b)
        return {"valid": found.related, "errors": [] if found.related else [found.reason], "columns": a.columns, "schema_profile": found.as_dict()}

    def analyze_schema(self, a: DataFrame, b: DataFrame, override: dict | None = None) -> schema.SchemaProfile:
        return schema.analyze(prepare.rename_aliases(a), prepare.rename_aliases(b), override)

    def strict_schema(self, a: object, b: object) -> schema.SchemaProfile | None:
        """The plan of two files with one header, else nothing."""
        one, two = read_header(self.spark, a), read_header(self.spark, b)
        return schema.header_plan(one) if one and schema.strict_match(one, two) else None

    # ---- matching ----------------------------------------------------------------

    def ingest(self, a: DataFrame, b: DataFrame, *, override: dict | None = None, judge: Callable[[dict], bool] | None = None) -> dict:
        """The gate before ``resolve``: tables of one header pass, others if the plan, or ``judge`` on it, relates them.

        The reply's status is ``reupload_required``, ``llm_required`` (decide,
        then finalise) or ``completed`` (finalise).
        """
        strict = schema.strict_match(a.columns, b.columns)
        found = self.analyze_schema(a, b, override)
        related = strict or (judge(found.as_dict()) if judge else found.related)
        gate = "strict_schema_matched" if strict else "schema_judged"
        refuse = lambda why: {"status": "reupload_required", "relation_type": "dataset_type_mismatch", "gate": gate, "message": why, "next": None}
        if not related:
            return refuse(found.reason)
        try:
            run = self.resolve(a, b, override=override if found.related else {**(override or {}), "related": True})
        except SchemaMismatch as e:
            return refuse(str(e))
        return {"status": run.status, "relation_type": "same_entity_table", "gate": gate, "match_run_id": run.run_id, "message": "", "next": "adjudicate" if run.status == "llm_required" else "finalize"}

    def resolve(self, a: DataFrame, b: DataFrame, *, override: dict | None = None, names: tuple[str, str] = ("table1", "table2")) -> Run:
        """Initial load: profile, candidates, scores, routes, and master tables."""
        a, b = prepare.rename_aliases(a), prepare.rename_aliases(b)
        found = schema.analyze(a, b, override)
        reason = None if found.related else found.reason
        if reason := reason or schema.incompatible(a, b, found):
            raise SchemaMismatch(reason)
        left, right = (graph.settled(schema.apply_profile(x, found, side)) for x, side in ((a, "a"), (b, "b")))
        pairs = blocking.block_schema(left, right, cap=blocking.posting_cap(right.count(), self.most_postings), weights=schema.part_weights(found), blocking=schema.blocking_parts(found))
        scored = self.schema_scores(schema.with_mapped(pairs, found), found)
        strict = found.entity_type in ("product", "unknown", "")
        return self._plan(scored.withColumn("conflict", _conflict() if strict else F.lit(False)), left, right, names, found, titles=(left, right))

    def schema_scores(self, pairs: DataFrame, found: schema.SchemaProfile) -> DataFrame:
        """All score columns of the schema regime: the weighted similarity stands for each, its rank for the fusion."""
        out = graph.settled(schema.schema_features(pairs, found))
        out = scoring.rank_pct(out, "schema_weighted_similarity", "rank_fusion_score")
        return out.withColumns({c: F.col("schema_weighted_similarity") for c in ("gbt_score", "mlp_score", "lexical_score", "confidence")})

    def train(self, labeled: DataFrame, valid: DataFrame, path: str, *, tables: tuple[DataFrame, ...] = (), **rounds: int) -> dict[str, float]:
        """Train on labeled pairs (l_ and r_ columns id, title, manufacturer, price, and label) and keep the bundle below ``path``; its measures.

        Terms are counted over ``tables``, or over the pairs without them.
        """
        ready = [blocking.pair_sides(x) for x in (labeled, valid)]
        records = None
        for i, t in enumerate(tables):
            own = prepare.preprocess(prepare.rename_aliases(t)).select(F.concat_ws(":", F.lit(i), "id").alias("id"), "title_norm")
            records = own if records is None else records.union(own)
        return feature_model.train(*ready, path, records=records, **rounds)

    def resolve_incremental(self, incoming: DataFrame, *, models: dict | str | None = None, name: str = "incoming", epoch: str | None = None) -> Run:
        """Rows that arrive later against the master, by the thirteen features.

        ``models`` is a bundle or its path.  A bundle brings the statistics of
        its training; without one those of all rows that have arrived serve,
        to which these are added under ``epoch``.
        """
        right = prepare.with_tokens(self._canonical(incoming))
        # Rows that are linked already arrive twice without effect.
        known = self.table("links").where(F.col("source_table") == name).select(F.col("source_id").alias("id"))
        right = right.join(known, "id", "left_anti")
        if self.store.read("entities") is None:
            raise SchemaMismatch("there is no master to match against")
        bundle = feature_model.load(self.spark, models)[0] if isinstance(models, str) else dict(models or {})
        master = master_scan(self.table("entities"), self.table("golden"))
        left, right = graph.settled(prepare.with_tokens(prepare.preprocess(master))), graph.settled(right)
        pairs = blocking.block_canonical(left, right, makers=self.most_postings)
        if bundle.get("features") is None:
            bundle["features"] = feature_model.TitleFeaturesModel(self.title_statistics(right))
        scored, refitted = feature_model.score(pairs, bundle)
        run = self._plan(scored.withColumn("conflict", _conflict()), left, right, ("master", name), None, epoch=epoch, titles=(right,))
        run.refitted = refitted
        return run

    def _canonical(self, table: DataFrame) -> DataFrame:
        """A source table in canonical columns: by the master's plan if it has that plan's columns, else by the required ones."""
        table = prepare.rename_aliases(table)
        told = self._planned()
        if told:
            plan = schema.SchemaProfile(**told)
            for side, names in (("a", plan.column_mapping), ("b", plan.column_mapping.values())):
                if set(names) <= set(table.columns):
                    return schema.apply_profile(table, plan, side)
        if errors := prepare.missing_columns(table):
            raise SchemaMismatch("; ".join(errors))
        return prepare.preprocess(table)

    def _plan(self, scored: DataFrame, left: DataFrame, right: DataFrame, names: tuple[str, str], found: schema.SchemaProfile | None, *, epoch: str | None = None, titles: tuple[DataFrame, ...] = ()) -> Run:
        scored = graph.settled(scored)
        mutual = graph.settled(graph.mutual_best(scored).select("l_id", "r_id", "confidence"))
        rest = graph.retained(scored, mutual)
        routed = graph.settled(graph.numbered(graph.routed(graph.clusters(rest, graph.components(rest)))))
        single = routed.where("routing_decision = 'auto_merge'").select(F.col("l_ids")[0].alias("l_id"), F.col("r_ids")[0].alias("r_id"), F.col("max_confidence").alias("confidence"))
        auto, pending = graph.settled(mutual.unionByName(single)), routed.where("routing_decision = 'llm_cluster'")
        used = auto.select("l_id", "r_id").unionByName(pending.select(F.explode("l_ids").alias("l_id"), F.lit(None).alias("r_id"))).unionByName(pending.select(F.lit(None).alias("l_id"), F.explode("r_ids").alias("r_id")))
        low = graph.low_pairs(scored, used).agg(F.count("*").alias("count"), F.max("confidence").alias("best")).first().asDict()
        run = Run(uuid.uuid4().hex, "llm_required" if not pending.isEmpty() else "completed", found, auto, pending, low)
        expected = {} if names[0] == "master" else {"expected_a": left.count(), "expected_b": right.count()}
        document = {"status": run.status, "profile": found.as_dict() if found else None, "clusters": pending.count(), "low": low, "names": names, **expected}
        change = self.store.change()
        kept = [(left, names[0])] * (names[0] != "master") + [(right, names[1])]
        document["snapshots"] = {name: self._snapshot(change, _rows(df, name, "l").drop("side", "id"), name) for df, name in kept}
        change.append("runs", self._rows("runs", (run.run_id, json.dumps(document), time.time())))
        self._count_titles(change, epoch or run.run_id, *titles)
        self._commit(change, run, scored, left, right, names)
        change.commit()
        return run

    def _snapshot(self, change: Change, rows: DataFrame, name: str) -> str:
        """Keep a copy of source rows under the hash of their content, unless there is one; the hash, which the order of the rows does not change."""
        entries = F.array_sort(F.map_entries("attributes"))
        each = F.xxhash64(*[c for c in rows.columns if c != "attributes"], entries)
        n, one, two = rows.agg(F.count("*"), F.bit_xor(each), F.sum(each.cast("decimal(38,0)"))).first()
        digest = f"{name}-{n}-{(one or 0) & (1 << 64) - 1:016x}-{int(two or 0) & (1 << 64) - 1:016x}"
        if self.table("snapshots").where(F.col("snapshot") == digest).isEmpty():
            change.append("sources", self._shaped("sources", rows.withColumn("snapshot", F.lit(digest))))
            change.append("snapshots", self._rows("snapshots", (digest, name, n)))
        return digest

    def _commit(self, change: Change, run: Run, scored: DataFrame, left: DataFrame, right: DataFrame, names: tuple[str, str]) -> None:
        """Merged pairs and unmatched rows become entities; rows of pending clusters wait for their decision."""
        whole = scored.join(run.auto.select("l_id", "r_id"), ["l_id", "r_id"], "left_semi")
        merged = whole.select(
            F.concat(F.lit("pair:"), "l_id", F.lit("|"), "r_id").alias("cand_id"), golden.pair_title(F.col("l_title"), F.col("r_title")).alias("title"), F.lit("auto").alias("source"), "confidence",
            F.lit("clear best pair").alias("reason"), F.lit(None).cast("string").alias("entity_id"), _as_members(whole, names[1]).alias("members"), _side(whole, "l").alias("table1"),
            (_side(whole, "r") if names[0] != "master" else F.lit(None).cast(commit.SIDE)).alias("table2"), F.lit(None).cast("map<string,string>").alias("attributes"),
            F.struct("gbt_score", "mlp_score", "lexical_score", "rank_fusion_score", "confidence").cast(commit.SCORES).alias("scores"),
        )
        if names[0] != "master":
            merged = merged.withColumn("members", F.lit(None).cast(f"array<{commit.MEMBER}>"))
        pending = run.pending.select(F.col("component").alias("cluster_id"), "cluster_seq", "max_confidence", "l_ids", "r_ids")
        waiting = [pending.select("cluster_id", "cluster_seq", "max_confidence", F.lit(side).alias("side"), F.explode(f"{side}_ids").alias("id")) for side in ("l", "r")]
        waiting = graph.settled(waiting[0].unionByName(waiting[1]))
        rows = _rows(left, names[0], "l").unionByName(_rows(right, names[1], "r"))
        taken = run.auto.select(F.lit("l").alias("side"), F.col("l_id").alias("id")).union(run.auto.select(F.lit("r"), "r_id"))
        alone = rows.where(F.col("source_table") != "master").join(taken.union(waiting.select("side", "id")), ["side", "id"], "left_anti")
        self._stage(change, merged.unionByName(self._single(alone, "auto", "no partner")), run.run_id, schema.master_specs(run.profile) if run.profile else self.specs())
        held = rows.join(waiting, ["side", "id"]).select(
            F.lit(run.run_id).alias("run_id"), "cluster_id", "cluster_seq", F.concat_ws(":", "source_table", F.regexp_replace("source_id", "^entity:", "")).alias("node_id"),
            "source_table", F.regexp_replace("source_id", "^entity:", "").alias("source_id"), "title", "manufacturer", "price", "max_confidence", "attributes",
        )
        change.append("waiting", self._shaped("waiting", held))

    def _single(self, rows: DataFrame, source: str, reason: str) -> DataFrame:
        """Candidates of one row each."""
        member = F.struct("source_table", "source_id", "title", "manufacturer", F.col("price").cast("string").alias("price"), "attributes")
        made = rows.select(
            F.concat_ws(":", "source_table", "source_id").alias("cand_id"), F.col("title").alias("title"), F.lit(source).alias("source"), F.lit(1.0).alias("confidence"), F.lit(reason).alias("reason"),
            F.array(member).alias("members"), F.lit(None).cast(commit.SCORES).alias("scores"),
        )
        return commit.candidates_from_members(made).withColumns({"table1": F.lit(None).cast(commit.SIDE), "table2": F.lit(None).cast(commit.SIDE)})

    # ---- decisions ---------------------------------------------------------------

    def expected_members(self, run_id: str, offset: int = 0, limit: int | None = None) -> DataFrame:
        """(cluster_id, member) of a run's waiting clusters, in the batch of their numbers."""
        found = self.table("waiting").where(F.col("run_id") == run_id)
        if limit is not None:
            found = found.where((F.col("cluster_seq") > offset) & (F.col("cluster_seq") <= offset + limit))
        return found.select("cluster_id", "cluster_seq", F.col("node_id").alias("member"), "title").distinct()

    def cluster_batch(self, run_id: str, offset: int = 0, limit: int = 30) -> DataFrame:
        limit, offset = min(max(limit, 1), 100), max(offset, 0)
        return self.expected_members(run_id, offset, limit)

    def commit_batch(self, run_id: str, answer: object, *, offset: int = 0, limit: int = 50, source: str = "llm") -> dict:
        """Commit one batch of clusters by a model's answer.

        A stopped run and a batch that is committed already change nothing.
        Of the batch the clusters from its start that the answer names are
        taken; each must name all its members once.  Else the batch is to be
        asked again, and after the third failure the run stops.
        """
        document = self.run_document(run_id)
        state = adjudicate.BatchState(document.get("batches"))
        total = self.table("waiting").where(F.col("run_id") == run_id).agg(F.count_distinct("cluster_id")).first()[0]
        reply = lambda status, n=0, at=offset, more=None, message="": {"status": status, "match_run_id": run_id, "committed_count": n, "next_offset": at, "has_more": at < total if more is None else more, "message": message}
        if state.document["stopped"]:
            return reply("stopped", more=False, message=state.document["stopped"])
        if done := state.committed(offset, limit):
            return reply("already_committed", done["committed_count"], done["next_offset"])
        text = json.dumps(adjudicate.result_object(answer))
        given = graph.settled(adjudicate.parsed_results(self.spark.createDataFrame([(text,)], "answer string")))
        expected = graph.settled(self.expected_members(run_id, offset, limit))
        batch = expected.select("cluster_id", F.col("cluster_seq").alias("seq")).distinct()
        prefix = graph.settled(adjudicate.covered_prefix(batch, given.select("cluster_id")))
        wanted, asked = prefix.count(), batch.count()
        reason = "" if wanted else "no cluster from the start of the batch is answered"
        if wanted:
            own = expected.join(prefix.select("cluster_id"), "cluster_id", "left_semi")
            bad = adjudicate.validate_members(own.select("cluster_id", "member"), given.select("cluster_id", "member")).where("not valid").orderBy("cluster_id").first()
            blank = given.join(prefix.select("cluster_id"), "cluster_id", "left_semi").where("coalesce(trim(canonical_title), '') = ''").first()
            open_ = adjudicate.uncovered_members(own, given).first()
            reason = f"members of {bad['cluster_id']} are not named once" if bad else f"a title of {blank['cluster_id']} is missing" if blank else f"members of {open_['cluster_id']} are left open" if open_ else ""
        if reason:
            status = state.failed(offset, limit, reason)
            self._save_run(run_id, {**document, "batches": state.document})
            self._log("commit_batch_retry_required", {"run_id": run_id, "offset": offset, "limit": limit, "reason": reason})
            return reply(status, more=False if status.endswith("stopped") else None, message=reason)
        records = self.table("waiting").where(F.col("run_id") == run_id).join(prefix.select("cluster_id"), "cluster_id", "left_semi")
        made = graph.settled(adjudicate.joined_results(records, given))
        self._write(self._decided(made, source), run_id, self.specs(document))
        count, to = made.count(), offset + wanted
        status = "committed" if wanted == asked else "partial_committed"
        state.done(offset, limit, count, to, status)
        self._save_run(run_id, {**document, "batches": state.document})
        return reply(status, count, to)

    def _decided(self, made: DataFrame, source: str) -> DataFrame:
        """Candidates of decided entities; a member that is a master row names the entity."""
        out = commit.candidates_from_members(made.select(
            F.concat_ws("#", "cluster_id", F.col("entity_pos").cast("string")).alias("cand_id"), "title", F.lit(source).alias("source"), "confidence", "reason",
            "members", F.lit(None).cast(commit.SCORES).alias("scores"),
        ))
        master = F.get(F.filter("members", lambda m: m["source_table"] == "master"), 0)["source_id"]
        return out.withColumns({"entity_id": master, "members": F.filter("members", lambda m: m["source_table"] != "master")})

    def specs(self, document: dict | None = None) -> list[tuple[str, str]]:
        """(output, source) of the master columns: those a run's document plans, else those of the last run with a plan."""
        return schema.master_specs((document or {}).get("profile") or self._planned() or {}) or MASTER_SPECS

    def _planned(self) -> dict | None:
        """The profile of the last run that has one."""
        planned = self.table("runs").where(F.get_json_object("payload", "$.profile.master_columns").isNotNull())
        last = planned.orderBy(F.desc("updated_at")).select("payload").first()
        return json.loads(last["payload"])["profile"] if last else None

    def adjudicate(self, run_id: str, resolver: Resolver, *, limit: int = 30, rounds: int = 100) -> dict:
        """All waiting clusters, batch by batch, by a resolver from members to answers(answer); failures are collected.

        After ``rounds`` batches the reply says by ``has_more`` and
        ``next_offset`` what is left, as it does where a failure ends it.
        """
        offset, committed, failures, more = 0, 0, [], True
        for _ in range(rounds):
            members = self.cluster_batch(run_id, offset, limit)
            if members.isEmpty():
                more = False
                break
            answers = [r["answer"] for r in resolver(members).select("answer").collect()]  # a batch of at most 100 clusters
            merged = {"clusters": [c for a in answers for c in adjudicate.result_object(a).get("clusters", [])]}
            reply = self.commit_batch(run_id, merged, offset=offset, limit=limit)
            to, more, n = adjudicate.loop_state(reply)
            committed += n
            if reply["status"] not in ("committed", "partial_committed", "already_committed"):
                failures.append(reply)
                if not more:
                    break
                continue
            offset = to
            if not more:
                break
        left = self.table("waiting").where((F.col("run_id") == run_id) & (F.col("cluster_seq") > offset)).agg(F.count_distinct("cluster_id")).first()[0]
        return {"committed_count": committed, "next_offset": offset, "has_more": left > 0, "left": left, "failures": failures}

    # ---- finalise ----------------------------------------------------------------

    def finalize(self, run_id: str) -> DataFrame:
        """Undecided rows by their titles, source rows that lost their link, then duplicate titles and aliases, then the golden table and its quality."""
        keys = ["source_table", "source_id"]
        left = self.table("waiting").where((F.col("run_id") == run_id) & (F.col("source_table") != "master")).join(self.table("links").select(*keys), keys, "left_anti")
        left = graph.settled(left.dropDuplicates(keys))
        if not left.isEmpty():
            norm = normalize_text(F.col("title"))
            own = left.withColumn("key", F.when(golden.safe_key(norm), F.concat(F.lit("title:"), norm)).otherwise(F.col("node_id")))
            made = own.groupBy("cluster_id", "key").agg(adjudicate.members_of(own.columns).alias("members"), F.max("max_confidence").alias("best"))
            many = F.size("members") > 1
            made = made.select(
                F.concat_ws("#", "cluster_id", "key").alias("cand_id"), F.lit(None).cast("string").alias("title"), F.lit("auto").alias("source"), F.when(many, F.col("best")).otherwise(1.0).alias("confidence"),
                F.when(many, "one safe title").otherwise("left open").alias("reason"), "members", F.lit(None).cast(commit.SCORES).alias("scores"),
            )
            self._write(commit.candidates_from_members(made), run_id, self.specs())
        self._repair_snapshots(run_id)
        self.merge_duplicates(run_id)
        return self.quality()

    def _repair_snapshots(self, run_id: str) -> None:
        """Link the run's source rows that no entity holds, from the copies that were kept of both tables."""
        try:
            snapshots = self.run_document(run_id).get("snapshots") or {}
        except KeyError:
            return
        for name, digest in snapshots.items():
            own = self.table("sources").where(F.col("snapshot") == digest)
            n = self._relink(own.drop("snapshot"), name)
            if n:
                self._log("repair_links", {"source_table": name, "count": n, "run_id": run_id})

    def _relink(self, rows: DataFrame, name: str) -> int:
        """Entities of their own for rows (source_table, source_id, title, manufacturer, price, attributes) without a link; the number of them."""
        lost = graph.settled(golden.unlinked(rows, self.table("links"), name))
        n = lost.count()
        if n:
            self._write(self._single(lost, "auto", "repaired link"), "", self.specs())
        return n

    def merge_duplicates(self, run_id: str = "") -> None:
        """Merge entities of one safe title, then of one safe alias, and bring the golden table up to date; only changed rows are written."""
        before, aliases, links = (self.table(x) for x in ("entities", "aliases", "links"))
        entities = before
        remap = graph.settled(golden.duplicate_titles(entities))
        if not remap.isEmpty():
            entities, aliases, links = (graph.settled(t) for t in golden.merge_entities(entities, aliases, links, remap))
        entities, aliases, links = golden.merge_duplicate_aliases(entities, aliases, links)
        gone = graph.settled(before.select("entity_id").join(entities.select("entity_id"), "entity_id", "left_anti"))
        change = self.store.change()
        kept = None
        if not gone.isEmpty():
            moved = self.table("links").select("source_table", "source_id", "entity_id").join(gone, "entity_id")
            to = graph.settled(moved.join(links.select("source_table", "source_id", F.col("entity_id").alias("keep")), ["source_table", "source_id"]).select("entity_id", "keep").distinct())
            change.append("decisions", self._shaped("decisions", golden.merge_decisions(to, run_id, "duplicate title or alias")))
            kept = graph.settled(to.select(F.col("keep").alias("entity_id")).distinct())
            own = lambda n, df: graph.settled(self._shaped(n, df.join(kept, "entity_id", "left_semi")))
            change.upsert("entities", own("entities", entities), ["entity_id"], deletes=gone)
            change.upsert("aliases", own("aliases", aliases), commit.INSERT_KEYS["aliases"], deletes=gone)
            change.upsert("links", own("links", links), commit.INSERT_KEYS["links"])
        self._refresh(change, entities, kept, gone)
        change.commit()

    def _refresh(self, change: Change, entities: DataFrame, kept: DataFrame | None, gone: DataFrame | None) -> None:
        """Golden rows of entities that have none from their present state; those of entities that are gone go."""
        fresh = self.table("golden").where("source = 'entity_snapshot'").select("entity_id")
        stale = entities.join(fresh if kept is None else fresh.join(kept, "entity_id", "left_anti"), "entity_id", "left_anti")
        made = golden.golden_from_entities(stale).join(stale.select("entity_id", "selected_source_table"), "entity_id")
        change.upsert("golden", graph.settled(self._shaped("golden", made)), ["entity_id"], deletes=gone, keys=KEYS["golden"])

    def repair(self, source: DataFrame, name: str) -> int:
        """Link source rows that no entity holds; the number of them."""
        n = self._relink(_rows(self._canonical(source), name, "l").drop("side", "id"), name)
        if n:
            self._log("repair_links", {"source_table": name, "count": n})
        return n

    def backfill(self) -> None:
        """Lineage labels and states where they are missing."""
        fixed = commit.backfill(self.table("entities"), self.table("golden"), self.table("aliases"), self.table("links"))
        change = self.store.change()
        for n, df in zip(("entities", "golden"), [graph.settled(df) for df in fixed], strict=True):
            change.replace(n, df, KEYS[n])
        change.commit()

    def rebuild(self) -> None:
        """One golden row for each entity, from the entities alone; all rows are written."""
        entities = self.table("entities")
        made = golden.golden_from_entities(entities).join(entities.select("entity_id", "selected_source_table"), "entity_id")
        self.store.write("golden", self._shaped("golden", made), KEYS["golden"])

    # ---- reading -----------------------------------------------------------------

    def golden(self, **paging) -> DataFrame:
        return golden.page(golden.golden_read(self.table("golden"), self.table("aliases"), self.table("links")), "entity_id", **paging)

    def master(self, specs: list[tuple[str, str]] | None = None, **paging) -> DataFrame:
        return golden.page(commit.master_view(self.table("golden"), self.table("entities"), specs or self.specs()), "id", **paging)

    def quality(self) -> DataFrame:
        try:
            document = self.run_document()
        except KeyError:
            document = {}
        first = self.table("runs").where(F.get_json_object("payload", "$.expected_a").isNotNull()).orderBy(F.desc("updated_at")).select("payload").first()
        expected = json.loads(first["payload"]) if first else document
        return golden.entity_quality(
            self.table("entities"), self.table("golden"), self.table("links"), self.table("aliases"), self.table("decisions"), expected_a=expected.get("expected_a"), expected_b=expected.get("expected_b")
        )

    def evaluate(self, truth: DataFrame) -> DataFrame:
        """The report of the links against reference(entity_id, title, ref)."""
        links = self.table("links").select("entity_id", F.concat_ws(":", "source_table", "source_id").alias("ref"))
        return evaluation.eval_report(links, truth, self.table("entities"))

    def report(self, truth: DataFrame, path: str) -> None:
        """Write the measures against a reference, and the clusters that differ."""
        links = self.table("links").select("entity_id", F.concat_ws(":", "source_table", "source_id").alias("ref"))
        write_report(self.evaluate(truth), evaluation.mismatch_rows(links, truth, self.table("entities")), path)

    def search(self, query: str, limit: int = 10) -> DataFrame:
        read = golden.golden_read(self.table("golden"), self.table("aliases"), self.table("links"))
        return golden.search(read, query, ["title", "manufacturer", "selected_source_table", "source", "aliases", "links"], limit=limit)

    def dashboard(self, truth: DataFrame | None = None) -> dict[str, DataFrame]:
        """The series of the charts, runs, quality, and with a reference its evaluation."""
        out = {
            "series": golden.chart_series(self.table("entities"), self.table("decisions"), self.table("links")), "runs": latest_run(self.table("runs")), "quality": self.quality(),
        }
        return out if truth is None else out | {"evaluation": self.evaluate(truth)}

    # ---- review ------------------------------------------------------------------

    def create_review(self, pairs: DataFrame) -> str | None:
        """A task of pairs with titles that wait for a person; none if there are no pairs."""
        if pairs.isEmpty():
            return None
        task = uuid.uuid4().hex
        self._append("tasks", review.review_task(pairs, task))
        return task

    def review_page(self, task: str, page: int = 1, page_size: int = 50) -> DataFrame:
        return review.review_page(self.table("tasks").where(F.col("task_id") == task), page, page_size)

    def submit_review(self, task: str, choices: DataFrame) -> int:
        """Commit the choices(position, choice) of a task; the number of them."""
        made = graph.settled(review.apply_choices(self.table("tasks").where(F.col("task_id") == task), choices))
        n = made.count()
        if n:
            self._write(made, task, self.specs())
        return n


def _conflict() -> Column:
    return graph.field_conflict(F.col("l_maker"), F.col("r_maker"), F.col("l_price"), F.col("r_price"))


def _record(df: DataFrame, p: str) -> list[Column]:
    """Title, raw maker, price and attributes of one side of a pair."""
    maker = F.nullif(F.coalesce(F.col(f"{p}_manufacturer"), F.lit("")), F.lit(""))
    more = F.col(f"{p}_attributes") if f"{p}_attributes" in df.columns else F.lit(None)
    return [F.col(f"{p}_title").alias("title"), maker.alias("manufacturer"), F.col(f"{p}_price").cast("string").alias("price"), more.cast(commit.ATTRIBUTES).alias("attributes")]


def _side(df: DataFrame, p: str) -> Column:
    return F.struct(F.col(f"{p}_id").cast("string").alias("id"), *_record(df, p)).cast(commit.SIDE)


def _as_members(df: DataFrame, name: str) -> Column:
    """The right row as a member of its own source table; the left one is a side."""
    return F.array(F.struct(F.lit(name).alias("source_table"), F.col("r_id").cast("string").alias("source_id"), *_record(df, "r"))).cast(f"array<{commit.MEMBER}>")


def _rows(df: DataFrame, name: str, side: str) -> DataFrame:
    return df.select(
        F.lit(side).alias("side"), F.col("id"), F.lit(name).alias("source_table"), F.col("id").alias("source_id"), "title", F.nullif("manufacturer", F.lit("")).alias("manufacturer"),
        F.col("price_norm").cast("string").alias("price"), (F.col("attributes") if "attributes" in df.columns else F.lit(None)).cast(commit.ATTRIBUTES).alias("attributes"),
    )
