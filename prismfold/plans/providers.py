"""Calls of a slow outside provider: dealt into small batches, each answer recorded before the next call is made.

Requests get stable batches by key, stored once for a folder. A task asks for its batches one after another and puts
each answer into a file of the shared folder; a batch that has its file is not asked again, whether the task is
tried again, the rows are read twice, or a new run goes on where the last one ended. What can be asked twice is one batch a
task: the one whose answer was on its way when the executor was lost.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismfold.functions.values import clamp01

#: A provider takes texts and the allowed values of each, and returns (value, confidence) for each.
Provider = Callable[[list[str], list[list[str]]], list[tuple[str | None, float]]]

#: Batches a shard holds, about: shards bound the sort that numbers the requests.
PER_SHARD = 50


def _files(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def _recorded(files: fs.FileSystem, path: str, texts: list[str]) -> list | None:
    """The answers of a batch, if there is a record of these texts."""
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(path) as stream:
        record = json.loads(stream.read())
    return record["answers"] if record["texts"] == texts else None


def _record(files: fs.FileSystem, path: str, texts: list[str], answers: list) -> None:
    draft = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as stream:
        stream.write(json.dumps({"texts": texts, "answers": answers}).encode())
    files.move(draft, path)


def _called(provider: Provider, texts: list[str], allowed: list[list[str]], tries: int, pause: float) -> tuple[list | None, str | None]:
    """The answers, or what the last of `tries` calls failed with."""
    error = None
    for turn in range(tries):
        if turn:
            time.sleep(pause * 2 ** (turn - 1))
        try:
            answers = [(value, float(confidence)) for value, confidence in provider(texts, allowed)]
            if len(answers) == len(texts):
                return answers, None
            error = f"{len(answers)} answers to {len(texts)} texts"
        except Exception as e:  # whatever the provider fails with is told in the answer
            error = f"{type(e).__name__}: {e}"[:200]
    return None, error


def batches(requests: DataFrame, key: str, batch: int) -> DataFrame:
    """shard, number, and the requests (key, text, allowed) of each batch, by key; of one key's requests the least."""
    one = requests.groupBy(F.col(key).alias("key")).agg(F.min(F.struct("text", "allowed")).alias("r")).select("key", "r.*")
    shards = max(1, one.count() // (batch * PER_SHARD))
    dealt = one.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    number = F.floor((F.row_number().over(Window.partitionBy("shard").orderBy("key")) - 1) / batch)
    return dealt.withColumn("number", number).groupBy("shard", "number").agg(F.array_sort(F.collect_list(F.struct("key", "text", "allowed"))).alias("requests"))


def ask(requests: DataFrame, provider: Provider, folder: str, *, key: str = "key", batch: int = 20, tries: int = 3, pause: float = 1.0, parallel: int = 8) -> DataFrame:
    """key, answer, confidence and error for requests (the key, text, allowed), each key once.

    Answers outside `allowed` are null with confidence 0, others are clamped to [0, 1]. A batch that fails `tries` times has
    null answers, confidence 0 and the error; it is not recorded, so that the next run with this folder asks it again.
    A folder is for one list of requests: a later run takes the list that its first run stored.
    Null texts are asked as empty ones; without `allowed` (null) every answer is. `parallel` tasks call at the same time.
    """
    spark, stored = requests.sparkSession, f"{folder}/requests"
    kind = requests.schema[key].dataType.simpleString()
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{stored}/_SUCCESS")
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        texts = requests.select(key, F.coalesce("text", F.lit("")).alias("text"), "allowed")
        batches(texts, key, batch).write.mode("overwrite").parquet(stored)  # what a run that was cut short left is no whole list

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _files(folder)
        system.create_dir(f"{root}/answers", recursive=True)
        for frame in frames:
            for shard, number, rows in frame[["shard", "number", "requests"]].itertuples(index=False):
                path, texts = f"{root}/answers/{shard}-{number}.json", [r["text"] for r in rows]
                answers, error = _recorded(system, path, texts), None
                if answers is None:
                    answers, error = _called(provider, texts, [list(r["allowed"]) if r["allowed"] is not None else [] for r in rows], tries, pause)
                    if error is None:
                        _record(system, path, texts, answers)
                    else:
                        answers = [(None, 0.0)] * len(texts)
                values = [(r["key"], r["allowed"], a, c, error) for r, (a, c) in zip(rows, answers)]
                yield pd.DataFrame(values, columns=["key", "allowed", "answer", "confidence", "error"])

    # few rows at a time go to Python, so that no answer waits for others to be handed on
    asked = spark.read.parquet(stored).repartition(parallel, "shard", "number")
    told = asked.mapInPandas(call, f"key {kind}, allowed array<string>, answer string, confidence double, error string")
    valid = F.col("answer").isNotNull() & (F.col("allowed").isNull() | F.coalesce(F.array_contains("allowed", F.col("answer")), F.lit(False)))
    return told.select(
        F.col("key").alias(key), F.when(valid, F.col("answer")).alias("answer"), F.when(valid & ~F.isnan("confidence"), clamp01(F.col("confidence"))).otherwise(0.0).alias("confidence"), "error"
    )


def map_texts(holdings: DataFrame, mapped: DataFrame, nodes: DataFrame, provider: Provider, folder: str, **options) -> DataFrame:
    """reported_sector, the columns of `nodes` (code and more), confidence and rationale of the trimmed sector texts that
    `mapped` lacks (exact case); empty texts and "nan" are none. A code that `nodes` lacks has nulls and confidence 0."""
    texts = holdings.select(F.trim("reported_sector").alias("reported_sector")).filter("reported_sector <> '' and lower(reported_sector) <> 'nan'").distinct()
    fresh = texts.join(mapped.select("reported_sector"), "reported_sector", "left_anti")
    told = ask(fresh.select("reported_sector", F.col("reported_sector").alias("text"), F.lit(None).cast("array<string>").alias("allowed")), provider, folder, key="reported_sector", **options)
    known = told.join(nodes.withColumn("answer", F.col("code")), "answer", "left")
    invalid = F.when(F.col("code").isNull(), F.concat(F.lit("Invalid code returned: "), F.coalesce("answer", F.lit("none"))))
    confidence = F.when(F.col("code").isNotNull(), F.col("confidence")).otherwise(0.0)
    return known.select("reported_sector", *nodes.columns, confidence.alias("confidence"), F.coalesce("error", invalid).alias("rationale"))


def write_back_classes(companies: DataFrame, classified: DataFrame, nodes: DataFrame, unknown: str) -> DataFrame:
    """`companies` with sector, industry and node of their surest industry (node_id) in `classified`; the unknown node and nodes that
    `nodes` (node_id, industry, sector) lacks change nothing."""
    sure = classified.filter((F.col("taxonomy_type") == "industry") & (F.col("node_id") != unknown))
    best = sure.groupBy("company_id").agg(F.max_by("node_id", F.struct(F.coalesce("confidence", F.lit(-1.0)), "node_id")).alias("node_id"))
    told = best.join(nodes.select("node_id", F.col("industry").alias("new_industry"), F.col("sector").alias("new_sector")), "node_id").withColumnRenamed("node_id", "new_node")
    joined = companies.join(told, "company_id", "left")
    new = {"primary_sector": "new_sector", "primary_industry": "new_industry", "industry_node_id": "new_node"}
    return joined.select(*[F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in companies.columns])
