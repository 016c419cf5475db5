"""The seam for models: a client of the caller's answers tasks in Arrow batches; what it says binds nobody.

A client takes a prompt and gives text.  It is called for tasks within the budget only,
its answer must be JSON, and whatever goes wrong makes a task unresolved, never a job fail.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.routing import bounded, within_budget

Client = Callable[[str], str]
ANSWER = "task_id string, answer string, failure string"


def ask(tasks: DataFrame, client: Client) -> DataFrame:
    """task_id, answer (JSON) or failure for each task (task_id, prompt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for task, prompt in zip(batch.column("task_id").to_pylist(), batch.column("prompt").to_pylist()):
                try:
                    answer = json.loads(client(prompt))
                    if not isinstance(answer, dict):
                        raise ValueError("the answer is no mapping")
                    rows.append((task, json.dumps(answer, sort_keys=True), None))
                except Exception as error:  # the model's failure is the task's, not the job's
                    rows.append((task, None, type(error).__name__))
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["task_id", "answer", "failure"])

    return tasks.select(F.col("task_id").cast("string").alias("task_id"), "prompt").mapInArrow(run, ANSWER)


def resolve(tasks: DataFrame, client: Client, relation_types: tuple[str, ...], anchors: DataFrame, calls: int) -> DataFrame:
    """task_id, target_id, relation_type, confidence, status of tasks (run_id, task_id, relation_type, prompt).

    At most ``calls`` tasks of a run are asked; ``status`` is ``inferred`` only for a known
    target and an allowed relation, else why the task stays unresolved.
    """
    rows = within_budget(tasks.withColumn("task_id", F.col("task_id").cast("string")), calls)
    said = ask(rows.where("decision = 'send'"), client).withColumnRenamed("task_id", "t_")
    value = F.from_json("answer", "target_id string, confidence double")
    joined = rows.join(said, F.col("task_id") == F.col("t_"), "left").withColumn("v_", value)
    checked = bounded(joined.select("task_id", "relation_type", F.col("v_.target_id").alias("target_id"), F.col("v_.confidence").alias("confidence"), "decision", "failure"), relation_types, anchors)
    status = F.when(F.col("decision") != "send", F.col("decision")).when(F.col("failure").isNotNull(), F.concat(F.lit("inference_failed:"), "failure")).otherwise(F.col("status"))
    return checked.select("task_id", F.when(status == "inferred", F.col("target_id")).alias("target_id"), "relation_type", F.when(status == "inferred", F.col("confidence")).alias("confidence"), status.alias("status"))


def enhance(sections: DataFrame, client: Client, model: str) -> DataFrame:
    """section_id, model, title, tags, authoritative (never) suggested for sections (section_id, text)."""
    prompt = F.concat(F.lit("Suggest a title and tags for: "), F.coalesce("text", F.lit("")))
    said = ask(sections.select(F.col("section_id").alias("task_id"), prompt.alias("prompt")), client)
    value = F.from_json("answer", "title string, tags array<string>")
    return said.select(F.col("task_id").alias("section_id"), F.lit(model).alias("model"), value["title"].alias("title"), value["tags"].alias("tags"), F.lit(False).alias("authoritative"), "failure")
