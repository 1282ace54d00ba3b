"""Texts that are shown: money, badges, labels, records, model payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the vehicle classes, and the one for any other class.
CLASS_NAMES: Mapping[int, str] = {2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}
OTHER_CLASS = "car"


def _fixed(amount: Column, places: int) -> Column:
    """The amount with a set number of places, halves away from zero."""
    return F.round(amount.cast("decimal(24,6)"), places).cast("string")


def thousands_of_dollars(amount: Column, places: int = 1) -> Column:
    return F.concat(F.lit("$"), _fixed(amount.cast("decimal(24,6)") / F.lit(1000), places), F.lit("K"))


def dollars(amount: Column, places: int = 2) -> Column:
    return F.concat(F.lit("$"), _fixed(amount, places))


def grouped_number(amount: Column) -> Column:
    """Thousands separated by commas, at most three places, no trailing zeros."""
    spelled = F.format_number(F.round(amount.cast("decimal(24,6)"), 3), 3)
    return F.regexp_replace(spelled, r"\.?0+$", "")


def delay_badge(minutes: Column) -> tuple[Column, Column]:
    """(text, level) of a delay."""
    text = F.when(minutes == 0, F.lit("On Time")).otherwise(F.concat(minutes.cast("string"), F.lit(" min")))
    level = F.when(minutes == 0, F.lit("success")).when(minutes < 30, F.lit("warning")).otherwise(F.lit("danger"))
    return text, level


def route_label(origin: Column, destination: Column) -> Column:
    return F.concat(origin, F.lit(" → "), destination)


def place_label(code: Column, name: Column, city: Column | None = None) -> Column:
    label = F.concat(code, F.lit(" - "), name)
    return label if city is None else F.concat(label, F.lit(" ("), city, F.lit(")"))


def flight_label(number: Column, origin: Column, destination: Column) -> Column:
    return F.concat(number, F.lit(" - "), origin, F.lit(" to "), destination)


def class_name(class_id: Column, names: Mapping[int, str] = CLASS_NAMES, other: str = OTHER_CLASS) -> Column:
    pairs = [F.lit(v) for item in names.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), class_id), F.lit(other))


def vehicle_label(tracker: Column, speed: Column, heading: Column) -> Column:
    number = F.concat(F.lit("#"), tracker.cast("string"))
    moving = F.concat(number, F.lit(" "), speed.cast("long").cast("string"), F.lit(" km/h "), heading)
    return F.when(speed > 0, moving).otherwise(F.concat(number, F.lit(" "), heading))


def record_lines(names: Sequence[str]) -> Column:
    """A row as ``column: value`` lines."""
    return F.concat_ws("\n", *[
        F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit("None"))) for n in names
    ])


def model_payload(names: Sequence[str], params: Mapping[str, str]) -> Column:
    """One row as the JSON request of a model endpoint."""
    body = F.struct(
        F.struct(
            F.array(F.lit(0)).alias("index"),
            F.array(*[F.lit(n) for n in names]).alias("columns"),
            F.array(F.array(*[F.col(n).cast("string") for n in names])).alias("data"),
        ).alias("dataframe_split"),
        F.struct(*[F.lit(v).alias(k) for k, v in params.items()]).alias("params"),
    )
    return F.to_json(body)
