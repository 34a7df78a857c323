"""Decisions on clusters: tolerant parsing, validation, prefixes and idempotent commits."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MERGE_WORDS = ("same_entity", "same", "merge")
RESULT = (
    "clusters array<struct<cluster_id:string,entities:array<struct<canonical_title:string,members:array<string>,aliases:array<string>,confidence:double,decision:string,reason:string>>>>"
)
_THINK = re.compile(r"<think>.*?</think>", re.DOTALL | re.IGNORECASE)
_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")


def loads_tolerant(text: str | None, depth: int = 5) -> dict:
    """The object that a model's answer holds: nested strings are opened, thoughts and fences dropped, else {}."""
    value: object = text
    for _ in range(depth):
        if isinstance(value, dict):
            return value
        if isinstance(value, list):
            return {"items": value}
        if not isinstance(value, str):
            return {}
        bare = _FENCE.sub("", _THINK.sub("", value)).strip()
        try:
            value = json.loads(bare)
        except ValueError:
            decoder = json.JSONDecoder()
            for m in re.finditer(r"[{\[]", bare):
                try:
                    value = decoder.raw_decode(bare, m.start())[0]
                    break
                except ValueError:
                    continue
            else:
                return {}
    return value if isinstance(value, dict) else {"items": value} if isinstance(value, list) else {}


@F.pandas_udf(StringType())
def clean_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: json.dumps(loads_tolerant(x)))


def parsed_results(answers: DataFrame, column: str = "answer") -> DataFrame:
    """(cluster_id, canonical_title, confidence, decision, reason, member) of model answers."""
    out = answers.select(F.explode(F.from_json(clean_json(F.col(column)), RESULT)["clusters"]).alias("c"))
    out = out.select(F.col("c.cluster_id").alias("cluster_id"), F.posexplode("c.entities").alias("entity_pos", "e"))
    return out.select("cluster_id", "entity_pos", "e.canonical_title", "e.confidence", "e.decision", "e.reason", F.explode("e.members").alias("member"))


def validate_members(expected: DataFrame, given: DataFrame) -> DataFrame:
    """One row for each cluster of ``expected(cluster_id, member)``: missing, unexpected and repeated members, valid.

    Clusters that only ``given`` names are left out.
    """
    e = expected.distinct().withColumn("want", F.lit(1))
    g = given.groupBy("cluster_id", "member").agg(F.count("*").alias("times")).join(expected.select("cluster_id").distinct(), "cluster_id", "left_semi")
    both = e.join(g, ["cluster_id", "member"], "full")
    out = both.groupBy("cluster_id").agg(
        F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("unexpected"), F.count_if(F.col("times") > 1).alias("repeated")
    )
    return out.withColumn("valid", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("repeated") == 0))


def covered_prefix(batch: DataFrame, covered: DataFrame) -> DataFrame:
    """The longest run of clusters from the batch's start (by ``seq``) that ``covered`` names."""
    hit = batch.join(covered.select("cluster_id").distinct().withColumn("hit", F.lit(1)), "cluster_id", "left")
    stop = hit.agg(F.min(F.when(F.col("hit").isNull(), F.col("seq"))).alias("stop"))
    return hit.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("seq") < F.col("stop"))).select("cluster_id", "seq")  # one row


def latest_only(results: DataFrame, batch: DataFrame) -> DataFrame:
    """Results of the batch's clusters; of repeated ones the last by ``pos``."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("pos"))
    own = results.join(batch.select("cluster_id"), "cluster_id", "left_semi")
    return own.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def is_merge(decision: Column) -> Column:
    return F.coalesce(decision, F.lit("same_entity")).isin(*MERGE_WORDS)


def cluster_batch(clusters: DataFrame, *, offset: int = 0, limit: int = 30) -> DataFrame:
    limit, offset = min(max(limit, 1), 100), max(offset, 0)
    return clusters.where((F.col("cluster_seq") > offset) & (F.col("cluster_seq") <= offset + limit))


def new_commits(commits: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose (offset, limit) is not committed yet."""
    return batch.join(commits.select("offset", "limit").distinct(), ["offset", "limit"], "left_anti")


def fallback_groups(uncovered: DataFrame) -> DataFrame:
    """Records of undecided clusters by normal title where that is safe, else alone: (cluster_id, key, members, merged)."""
    from goldweave.functions.text import normalize_text
    from goldweave.operators.golden import safe_key

    norm = normalize_text(F.col("title"))
    key = F.when(safe_key(norm), norm).otherwise(F.concat(F.lit("#"), F.col("node_id")))
    out = uncovered.groupBy("cluster_id", key.alias("key")).agg(F.array_sort(F.collect_set("node_id")).alias("members"))
    return out.withColumn("merged", F.size("members") > 1)


# Keys under which an answer may hold its result, in this order.
RESULT_KEYS = ["result", "text", "answer", "records", "choices", "items"]


def normalized_payload(payload: dict) -> dict:
    """A commit request with its result under ``llm_result`` and defaults for what is missing."""
    out = dict(payload)
    if "llm_result" not in out:
        out["llm_result"] = next((out[k] for k in RESULT_KEYS if k in out), None)
    return {"offset": 0, "limit": 50, "source": "llm", "reason": "", **{k: v for k, v in out.items() if v is not None}}


def result_object(answer: object) -> dict:
    """The object with clusters or records that an answer holds, however it is wrapped."""
    value = answer if isinstance(answer, dict) else loads_tolerant(answer if isinstance(answer, str) else json.dumps(answer))
    for _ in range(5):
        if "clusters" in value or any(isinstance(value.get(k), list) for k in ("records", "choices", "items", "entities")):
            return value
        inner = next((value[k] for k in ("llm_result", *RESULT_KEYS, "data", "outputs") if isinstance(value.get(k), (dict, str))), None)
        if inner is None:
            return value
        value = inner if isinstance(inner, dict) else loads_tolerant(inner)
    return value


def uncovered_members(expected: DataFrame, given: DataFrame) -> DataFrame:
    """Members of ``expected(cluster_id, member)`` that no merging entity of ``given`` names."""
    merged = given.where(is_merge(F.col("decision"))).select("cluster_id", "member").distinct()
    return expected.select("cluster_id", "member").distinct().join(merged, ["cluster_id", "member"], "left_anti")


def members_of(columns: list[str]) -> Column:
    """The distinct records of a group as an array of structs in the order of their fields; attributes, if any, come last and as a map."""
    fields = ["source_table", "source_id", "title", "manufacturer", "price"]
    # Maps neither sort nor compare, so they are entries until the set is made.
    entries = F.map_entries("attributes") if "attributes" in columns else F.lit(None).cast("array<struct<key:string,value:string>>")
    found = F.array_sort(F.collect_set(F.struct(*fields, F.array_sort(entries).alias("e"))))
    return F.transform(found, lambda m: F.struct(*[m[c].alias(c) for c in fields], F.map_from_entries(m["e"]).alias("attributes")))


def joined_results(records: DataFrame, results: DataFrame) -> DataFrame:
    """Entities of decided clusters with their members' records: cluster_id, entity_pos, title, confidence, reason, members.

    ``records`` has cluster_id, node_id, source_table, source_id, title,
    manufacturer, price, max_confidence and perhaps attributes; members that
    no record has, and clusters that are not asked for, are left out.
    ``foreign_title`` warns of a title that none of the members has.
    """
    wanted = results.where(is_merge(F.col("decision"))).select("cluster_id", "entity_pos", "canonical_title", "confidence", "reason", F.col("member").alias("node_id"))
    both = records.join(wanted, ["cluster_id", "node_id"])
    out = both.groupBy("cluster_id", "entity_pos").agg(
        F.first("canonical_title").alias("title"), F.coalesce(F.max("confidence"), F.max("max_confidence"), F.lit(0.9)).alias("confidence"), F.max("reason").alias("reason"),
        members_of(records.columns).alias("members"),
    )
    same = F.exists("members", lambda m: m["title"] == F.col("title"))
    return out.withColumn("foreign_title", ~F.coalesce(same, F.lit(False)))


def local_pairs(pairs: DataFrame) -> DataFrame:
    """Answers without a model: of each pair the longer raw title, the left one on a tie; clusters are left open."""
    l, r = F.coalesce("l_title", F.lit("")), F.coalesce("r_title", F.lit(""))  # noqa: E741
    return pairs.withColumns({"chosen_title": F.when(F.length(l) >= F.length(r), l).otherwise(r), "confidence": F.coalesce("confidence", F.lit(0.9))})


def knowledge_query(titles: list[str]) -> str:
    """What a reviewer looks up: the titles at hand, at most 1000 characters of them."""
    return "titles, brand aliases, makers, earlier matches: " + " | ".join(t for t in titles if t)[:1000]


def file_resolver(spark, path: str):
    """A resolver that takes its answers from JSON lines with cluster_id and answer."""

    def resolve(members: DataFrame) -> DataFrame:
        answers = spark.read.schema("cluster_id string, answer string").json(path)
        return answers.join(members.select("cluster_id").distinct(), "cluster_id", "left_semi")

    return resolve


class BatchState:
    """Retries, stop and commits of a run's batches, as one small document on the driver."""

    MOST = 3

    def __init__(self, document: dict | None = None) -> None:
        self.document = {"retries": {}, "commits": [], "stopped": None, **(document or {})}

    @staticmethod
    def key(offset: int, limit: int) -> str:
        return f"{offset}:{limit}"

    def committed(self, offset: int, limit: int) -> dict | None:
        return next((c for c in self.document["commits"] if (c["offset"], c["limit"]) == (offset, limit)), None)

    def failed(self, offset: int, limit: int, reason: str) -> str:
        """Counts a failure of the batch; the third one in a row stops the run."""
        n = self.document["retries"].get(self.key(offset, limit), 0) + 1
        self.document["retries"][self.key(offset, limit)] = n
        if n >= self.MOST:
            self.document["stopped"] = f"the batch failed {n} times: {reason}"
            return "invalid_llm_output_stopped"
        return "retry_required"

    def done(self, offset: int, limit: int, count: int, next_offset: int, status: str) -> None:
        self.document["retries"].pop(self.key(offset, limit), None)
        self.document["commits"].append({"offset": offset, "limit": limit, "committed_count": count, "next_offset": next_offset, "status": status})


def loop_state(reply: dict) -> tuple[int, bool, int]:
    """(next offset, whether more batches wait, committed entities) of a commit's reply."""
    return int(reply.get("next_offset") or 0), str(reply.get("has_more")).lower() == "true", int(reply.get("committed_count") or 0)
