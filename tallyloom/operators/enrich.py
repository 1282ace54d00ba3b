"""Model scoring, table functions, campaigns and artifact selection."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import text
from tallyloom.operators.ordering import number_rows
from tallyloom.session import work_path
from tallyloom.sources import versions

# The modes of the frame model, and the frames per request.
MODES = ("PITCH_DETECTION", "PLAYER_DETECTION", "BALL_DETECTION", "PLAYER_TRACKING", "TEAM_CLASSIFICATION", "RADAR")
SEQUENCE_MODES = ("PLAYER_TRACKING", "TEAM_CLASSIFICATION", "RADAR")
FRAMES_PER_REQUEST = 5
MIN_SEQUENCE = 3
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".webm")
WARNING_MARKS = ("⚠️", "❌")

Model = Callable[[pd.DataFrame], pd.DataFrame]


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; there are {', '.join(MODES)}")


def score_batch(df: DataFrame, load: Callable[[str], Model], mode: str, schema: str | T.StructType) -> DataFrame:
    """Rows scored by a model. ``load(mode)`` runs once in each task and gives a function on pandas batches."""
    _check_mode(mode)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(mode)
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(score, schema)


def score_sequence(df: DataFrame, keys: Sequence[str], order: Sequence[str], load: Callable[[str], Model], mode: str,
                   schema: str | T.StructType, length: int = FRAMES_PER_REQUEST) -> DataFrame:
    """Modes that need ordered frames: each request holds ``length`` frames that follow each other, and ``scored`` is added.

    A rest of fewer than three frames goes with the request before it. A sequence of fewer than three frames comes back not
    scored: with the columns it came with, and null for what only the model can tell.
    """
    _check_mode(mode)
    placed = number_rows(df, keys, order, "_position")
    sizes = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_size"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    # The last place at which a request may start.
    last = F.greatest(F.floor((F.col("_size") - MIN_SEQUENCE) / F.lit(length)), F.lit(0))
    cut = placed.join(sizes, same).withColumn(
        "_request", F.least(F.floor((F.col("_position") - 1) / F.lit(length)), last).cast("long"))
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    models: dict[str, Model] = {}

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        if len(batch) < MIN_SEQUENCE:
            return pd.DataFrame({n: batch[n] if n in batch else None for n in kind.names}).assign(scored=False)
        if mode not in models:
            models[mode] = load(mode)
        return models[mode](batch.sort_values("_position")).assign(scored=True)

    return cut.groupBy(*keys, "_request").applyInPandas(score, T.StructType([*kind.fields, T.StructField("scored", T.BooleanType())]))


def latest_artifact(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest video of each folder, a processed one before an uploaded one; ties go to the later path."""
    name = F.regexp_extract("path", r"[^/]*$", 0)
    kind = F.when(name.startswith("processed_video"), F.lit("processed")).when(
        name.startswith("uploaded_video"), F.lit("fallback"))
    videos = files.withColumn("kind", kind).filter(
        F.col("kind").isNotNull() & text.extension(F.col("path")).isin(*VIDEO_EXTENSIONS))
    rank = F.struct((F.col("kind") == "processed").alias("first"), F.col("modified_at"), F.col("path"))
    best = videos.groupBy(*keys).agg(F.max_by(F.struct("path", "kind"), rank).alias("best"))
    return best.select(*keys, "best.path", "best.kind")


def campaign_text(customer: Column, name: Column, segment: Column) -> Column:
    """Template of a campaign message."""
    return F.concat(F.lit("Dear "), name, F.lit(", we have an offer for "), F.lower(segment),
                    F.lit(" customers. Reference "), customer.cast("string"), F.lit("."))


def campaign_report(customer: Column, copy: Column) -> Column:
    """A message under the heading of its customer, as it is shown before it is sent."""
    rule = F.lit("=" * 60)
    return F.concat(F.lit("Customer ID: "), customer.cast("string"), F.lit("\n"), rule, F.lit("\n"), copy)


def valid_campaigns(campaigns: DataFrame, customer: str = "customer_id", copy: str = "marketing_copy") -> DataFrame:
    """Campaigns with a customer and a text that carries no warning mark."""
    def filled(c: str) -> Column:
        return F.coalesce(F.length(F.trim(F.col(c).cast("string"))) > 0, F.lit(False))
    marked = text.contains_any(F.col(copy), WARNING_MARKS)
    return campaigns.filter(filled(customer) & filled(copy) & ~marked)


def send_campaigns(campaigns: DataFrame, outbox: str, sent_at: Column) -> None:
    """Simulated delivery: valid campaigns are appended to the outbox with the time of sending."""
    versions.append_rows(valid_campaigns(campaigns).withColumn("sent_at", sent_at), outbox)


def per_customer(customers: DataFrame, function: Callable[..., DataFrame], *args: str) -> DataFrame:
    """A table function called for every row, side by side with the columns of the row."""
    called = function(*[F.col(a).outer() for a in args])
    return customers.lateralJoin(called)


ANSWERS = "digest string, answer string, error string"


def _ask(answer: Callable[[list], list[str]], pending: str, at_once: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Asks for what is not yet in ``pending``, a few requests at a time, and puts each answer there before it goes on."""
    def store():
        try:
            return fs.FileSystem.from_uri(pending)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
            return None, pending  # a store that only Spark reads: a task that is run again asks again

    def found(files, place: str) -> str | None:
        if files is None or files.get_file_info(place).type != fs.FileType.File:
            return None
        with files.open_input_stream(place) as text:
            return json.loads(text.read().decode())["answer"]

    def keep(files, place: str, text: str) -> None:
        if files is not None:
            staged = f"{place}-{uuid.uuid4().hex}"
            with files.open_output_stream(staged) as out:
                out.write(json.dumps({"answer": text}).encode())
            files.move(staged, place)

    def replies(requests: list) -> list[tuple[str | None, str | None]]:
        """(answer, error) of each request; if a call for several fails, each is asked by itself."""
        try:
            got = answer(requests)
            if len(got) != len(requests):
                raise ValueError(f"{len(got)} answers to {len(requests)} requests")
            return [(None, "no answer") if text is None else (str(text), None) for text in got]
        except Exception as error:  # noqa: BLE001
            if len(requests) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
            return [r for request in requests for r in replies([request])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = store()
        if files is not None:
            files.create_dir(folder, recursive=True)
        for batch in batches:
            out, open_ = [], []
            for digest, request in zip(batch["_digest"], batch["_request"]):
                text = found(files, f"{folder}/{digest}")
                if text is not None:
                    out.append((digest, text, None))
                else:
                    open_.append((digest, request))
            for at in range(0, len(open_), at_once):
                some = open_[at:at + at_once]
                for (digest, _), (text, error) in zip(some, replies([r for _, r in some])):
                    if error is None:
                        keep(files, f"{folder}/{digest}", text)
                    out.append((digest, text, error))
            yield pd.DataFrame(out, columns=["digest", "answer", "error"])

    return run


def complete(df: DataFrame, answer: Callable[[list], list[str]], column: str, out: str, ledger: str | None = None, model: str = "",
             at_once: int = 1) -> DataFrame:
    """A caller's chat model over a column of requests: ``out`` and, where the model failed, ``out``_error.

    Answers are kept in a ledger by the digest of model and request. Only distinct requests without an answer are asked, ``at_once``
    in a call. Each answer is put beside the ledger before the next call, so a task that is run again, or a job that is
    started again on the same ledger, repeats one call at most. A failed request makes its rows' error and no job fails; it is
    asked again by the next job. Null requests are not asked and have neither.
    """
    spark = df.sparkSession
    root = ledger or work_path(spark, "answers")
    digest = F.sha2(F.concat(F.lit(f"{model}\n"), F.to_json(F.struct(F.col(column).alias("request")))), 256)
    keyed = df.withColumn("_digest", F.when(F.col(column).isNotNull(), digest))
    asked = keyed.filter("_digest IS NOT NULL").select("_digest", F.col(column).alias("_request")).dropDuplicates(["_digest"])
    if versions.is_folder(spark, f"{root}/answers"):
        told = spark.read.schema(ANSWERS).parquet(f"{root}/answers").filter("error IS NULL").select("digest").distinct()
        asked = asked.join(told, F.col("_digest") == F.col("digest"), "left_anti")
    run = uuid.uuid4().hex[:12]
    asked.mapInPandas(_ask(answer, f"{root}/pending", at_once), ANSWERS).write.parquet(f"{root}/answers/run={run}")
    versions.remove_folder(spark, f"{root}/pending")
    told = spark.read.schema(f"{ANSWERS}, run string").parquet(f"{root}/answers").filter((F.col("run") == run) | F.col("error").isNull())
    best = told.groupBy(F.col("digest").alias("_told")).agg(F.min("answer").alias(out), F.min("error").alias("_error"))
    joined = keyed.join(best, F.col("_digest") == F.col("_told"), "left").withColumn(f"{out}_error", F.when(F.col(out).isNull(), F.col("_error")))
    return joined.drop("_digest", "_told", "_error")
