"""Traffic analytics: one row per vehicle, the 22-figure summary, chart data, trend and speed.

Everything about vehicles starts from ``vehicle_table``: one aggregation with map-side partials, so a vehicle
with very many sightings costs no more than a few rows in the shuffle. Vehicles are told apart by ``keys``, the car
number alone by default or video and car number together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ordering import (
    HOT_ROWS, first_and_last, scan_ranges, split_hot, with_ranges)

SPEED_LIMIT = 130
FPS = 30
BUFFER = 30
MIN_SIGHTINGS = 5
FORECAST_SHARE = 0.25
BINS = 20
KEYS = ("car_id",)

# The figures of the summary and their labels, in order.
METRICS: dict[str, str] = {
    "total_vehicles": "Total Vehicles Detected",
    "total_cars": "Cars",
    "total_trucks": "Trucks",
    "total_events": "Total Detection Events",
    "events_per_vehicle": "Avg Events per Vehicle",
    "car_percentage": "Cars Percentage (%)",
    "truck_percentage": "Trucks Percentage (%)",
    "avg_speed": "Average Speed (km/h)",
    "max_speed": "Maximum Speed (km/h)",
    "min_speed": "Minimum Speed (km/h)",
    "speed_std": "Speed Standard Deviation",
    "vehicles_per_minute": "Vehicles per Minute",
    "avg_vehicle_duration": "Avg Vehicle Duration (sec)",
    "speed_violations": "Speed Violations (>130 km/h)",
    "speed_violation_rate": "Speed Violation Rate (%)",
    "fastest_vehicle_type": "Fastest Vehicle Type",
    "slowest_vehicle_type": "Slowest Vehicle Type",
    "vehicles_in": "Vehicles Going IN",
    "vehicles_out": "Vehicles Going OUT",
    "vehicles_stationary": "Stationary Vehicles",
    "in_out_ratio": "IN/OUT Ratio",
    "direction_balance": "Direction Balance",
}
TEXT_METRICS = ("fastest_vehicle_type", "slowest_vehicle_type", "direction_balance")
BANDS = ((0, 80, "Slow (0-80)"), (80, 100, "Normal (80-100)"), (100, 130, "Fast (100-130)"), (130, None, "Speeding (>130)"))


def _rows() -> Column:
    return F.count(F.lit(1))


def vehicle_table(events: DataFrame, keys: Sequence[str] = KEYS, order: str = "event_id") -> DataFrame:
    """Per vehicle: maximum speed, sightings, first type, last direction, first and last frame.

    The first step counts by type and direction too, which needs numbers only and so is hashed without a sort; the
    second picks the first type and the last direction from the few rows of each vehicle.
    """
    seen = events.groupBy(*keys, "vehicle_type", "direction").agg(
        F.max("estimated_speed_kmh").alias("max_speed"), _rows().alias("sightings"),
        F.min(order).alias("_from"), F.max(order).alias("_to"),
        F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"),
    )
    first_type, _ = first_and_last("vehicle_type", "_from")
    _, last_direction = first_and_last("direction", "_to")
    return seen.groupBy(*keys).agg(
        F.max("max_speed").alias("max_speed"), F.sum("sightings").alias("sightings"),
        first_type.alias("vehicle_type"), last_direction.alias("direction"),
        F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"),
    )


def vehicle_table_at_once(events: DataFrame, keys: Sequence[str] = KEYS, order: str = "event_id") -> DataFrame:
    """The vehicle table in one aggregation, as a stream has to keep it."""
    first_type, _ = first_and_last("vehicle_type", order)
    _, last_direction = first_and_last("direction", order)
    return events.groupBy(*keys).agg(
        F.max("estimated_speed_kmh").alias("max_speed"), _rows().alias("sightings"),
        first_type.alias("vehicle_type"), last_direction.alias("direction"),
        F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"),
    )


def vehicle_rows(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Vehicle table without the order-dependent columns."""
    return events.groupBy(*keys).agg(F.max("estimated_speed_kmh").alias("max_speed"), _rows().alias("sightings"))


# The summary

def _share(part: Column, whole: Column) -> Column:
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0), 1)


def figures(vehicles: DataFrame) -> DataFrame:
    """All figures in one row, from the vehicle table in one pass. Over no vehicles the counts are 0."""
    speed = F.col("max_speed")
    car, truck = F.col("vehicle_type") == "car", F.col("vehicle_type") == "truck"

    def of(test: Column, value: Column) -> Column:
        return F.when(test, value)

    one = vehicles.agg(
        _rows().alias("total_vehicles"),
        F.count(of(car, F.lit(1))).alias("total_cars"),
        F.count(of(truck, F.lit(1))).alias("total_trucks"),
        F.coalesce(F.sum("sightings"), F.lit(0).cast("long")).alias("total_events"),
        F.sum(speed).alias("_speed_sum"), F.count(speed).alias("_speed_n"),
        F.max(speed).alias("max_speed"), F.min(speed).alias("min_speed"), F.stddev_samp(speed).alias("_std"),
        F.min("first_frame").alias("_first"), F.max("last_frame").alias("_last"),
        F.count(of(speed > SPEED_LIMIT, F.lit(1))).alias("speed_violations"),
        F.max(of(car, speed)).alias("_car_max"), F.max(of(truck, speed)).alias("_truck_max"),
        F.avg(of(car, speed)).alias("_car_avg"), F.avg(of(truck, speed)).alias("_truck_avg"),
        F.count(of(F.col("direction") == "in", F.lit(1))).alias("vehicles_in"),
        F.count(of(F.col("direction") == "out", F.lit(1))).alias("vehicles_out"),
        F.count(of(F.col("direction") == "stationary", F.lit(1))).alias("vehicles_stationary"),
    )
    return _finished(one)


def figures_of_counts(counts: DataFrame) -> DataFrame:
    """The same figures from vehicles counted by type, direction and maximum speed: ``n`` vehicles with ``sightings`` in all, and
    frames of which the first and last of all rows are those of all vehicles."""
    speed, n = F.col("max_speed"), F.col("n")
    car, truck = F.col("vehicle_type") == "car", F.col("vehicle_type") == "truck"
    whole = counts.schema["max_speed"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    exact = speed.cast("decimal(18,0)") if whole else speed.cast("double")
    known = F.when(speed.isNotNull(), n)

    def total_of(value: Column, test: Column | None = None) -> Column:
        return F.coalesce(F.sum(value if test is None else F.when(test, value)), F.lit(0).cast("long"))

    def mean_of(test: Column) -> Column:
        return F.try_divide(F.sum(F.when(test, speed * n)).cast("double"), F.sum(F.when(test, known)).cast("double"))

    one = counts.agg(
        total_of(n).alias("total_vehicles"), total_of(n, car).alias("total_cars"), total_of(n, truck).alias("total_trucks"),
        total_of(F.col("sightings")).alias("total_events"),
        F.sum(speed * n).alias("_speed_sum"), total_of(known).alias("_speed_n"), F.max(speed).alias("max_speed"), F.min(speed).alias("min_speed"),
        F.sum(exact * n).alias("_sum"), F.sum(exact * exact * n).alias("_squares"),
        F.min("first_frame").alias("_first"), F.max("last_frame").alias("_last"),
        total_of(n, speed > SPEED_LIMIT).alias("speed_violations"),
        F.max(F.when(car, speed)).alias("_car_max"), F.max(F.when(truck, speed)).alias("_truck_max"),
        mean_of(car).alias("_car_avg"), mean_of(truck).alias("_truck_avg"),
        *[total_of(n, F.col("direction") == word).alias(f"vehicles_{word}") for word in ("in", "out", "stationary")])
    m = F.col("_speed_n")
    spread = (F.col("_squares") * m - F.col("_sum") * F.col("_sum")).cast("double")
    std = F.when(m > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (m.cast("double") * (m - 1).cast("double"))))
    return _finished(one.withColumn("_std", std))


def _finished(one: DataFrame) -> DataFrame:
    total = F.col("total_vehicles")
    minutes = (F.col("_last") - F.col("_first") + 1).cast("double") / F.lit(float(FPS)) / F.lit(60.0)
    both = F.col("_car_max").isNotNull() & F.col("_truck_max").isNotNull()
    only = F.when(F.col("total_cars") > 0, F.lit("car")).when(F.col("total_trucks") > 0, F.lit("truck")).otherwise(F.lit("N/A"))
    came, went = F.col("vehicles_in"), F.col("vehicles_out")
    ratio = (
        F.when(went > 0, F.bround(F.try_divide(came.cast("double"), went.cast("double")), 2))
        .when(came > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    )
    balance = (
        F.when(came > went, F.lit("More vehicles going IN")).when(went > came, F.lit("More vehicles going OUT"))
        .otherwise(F.lit("Balanced traffic flow"))
    )
    return one.select(
        "total_vehicles", "total_cars", "total_trucks", "total_events",
        F.bround(F.try_divide(F.col("total_events").cast("double"), total.cast("double")), 1).alias("events_per_vehicle"),
        _share(F.col("total_cars"), total).alias("car_percentage"),
        _share(F.col("total_trucks"), total).alias("truck_percentage"),
        F.bround(F.try_divide(F.col("_speed_sum").cast("double"), F.col("_speed_n").cast("double")), 1).alias("avg_speed"),
        "max_speed", "min_speed", F.bround("_std", 1).alias("speed_std"),
        F.bround(F.try_divide(total.cast("double"), minutes), 1).alias("vehicles_per_minute"),
        F.bround(F.try_divide(F.col("total_events").cast("double"), total.cast("double")) / F.lit(float(FPS)), 1)
        .alias("avg_vehicle_duration"),
        "speed_violations", _share(F.col("speed_violations"), total).alias("speed_violation_rate"),
        F.when(both, F.when(F.col("_car_max") > F.col("_truck_max"), F.lit("car")).otherwise(F.lit("truck")))
        .otherwise(only).alias("fastest_vehicle_type"),
        F.when(both, F.when(F.col("_car_avg") < F.col("_truck_avg"), F.lit("car")).otherwise(F.lit("truck")))
        .otherwise(only).alias("slowest_vehicle_type"),
        "vehicles_in", "vehicles_out", "vehicles_stationary", ratio.alias("in_out_ratio"), balance.alias("direction_balance"),
    )


COUNT_BLOCK = ("total_vehicles", "total_cars", "total_trucks", "total_events", "events_per_vehicle", "car_percentage",
               "truck_percentage")
SPEED_BLOCK = ("avg_speed", "max_speed", "min_speed", "speed_std")
FLOW_BLOCK = ("vehicles_per_minute", "avg_vehicle_duration", "speed_violations", "speed_violation_rate")
TYPE_BLOCK = ("fastest_vehicle_type", "slowest_vehicle_type")
DIRECTION_BLOCK = ("vehicles_in", "vehicles_out", "vehicles_stationary", "in_out_ratio", "direction_balance")


def _spelled(name: str, kind: str) -> Column:
    """A figure as text: whole numbers plain, fractions with a point, ``inf`` and ``nan`` in small letters."""
    value = F.col(name)
    if name in TEXT_METRICS:
        return value
    if kind != "double":
        return value.cast("string")
    # Rounded to at most two places, so a decimal holds the figure exactly.
    digits = F.regexp_replace(value.try_cast("decimal(28,2)").cast("string"), r"(\.\d)0$", "$1")
    return F.when(F.isnan(value) | value.isNull(), F.lit("nan")).when(value == F.lit(float("inf")), F.lit("inf")).otherwise(digits)


def long_form(one: DataFrame) -> DataFrame:
    """The row of figures as 22 (metric, value) texts; without vehicles 0, or N/A where the figure is a text."""
    kinds = dict(one.dtypes)
    empty = F.col("total_vehicles") == 0
    cells = [
        F.struct(
            F.lit(label).alias("metric"),
            F.when(empty, F.lit("N/A" if name in TEXT_METRICS else "0")).otherwise(_spelled(name, kinds[name])).alias("value"),
        )
        for name, label in METRICS.items()
    ]
    return one.select(F.explode(F.array(*cells)).alias("cell")).select("cell.metric", "cell.value")


def summary(events: DataFrame, keys: Sequence[str] = KEYS, order: str = "event_id") -> DataFrame:
    return long_form(figures(vehicle_table(events, keys, order)))


def metric_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Metric names on one side only."""
    def only(a: DataFrame, b: DataFrame, word: str) -> DataFrame:
        names = a.select("metric").distinct()
        return names.join(b.select("metric"), "metric", "left_anti").withColumn("problem", F.lit(word))
    return only(expected, actual, "missing").unionByName(only(actual, expected, "unexpected"))


# Chart data

def value_counts(vehicles: DataFrame, column: str) -> DataFrame:
    counted = vehicles.filter(F.col(column).isNotNull()).groupBy(column).agg(_rows().alias("count"))
    return counted.orderBy(F.col("count").desc(), F.col(column).asc())


def speed_histogram(vehicles: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal bins over [min, max]; the maximum belongs to the last bin, and one value alone makes one bin.

    Speeds are counted before the range is looked up, so the second step sees one row per speed.
    """
    counted = vehicles.groupBy("max_speed").agg(_rows().alias("n"))
    span = counted.agg(F.struct(F.min("max_speed").alias("low"), F.max("max_speed").alias("high"))).scalar()
    width = (F.col("high") - F.col("low")).cast("double") / F.lit(float(bins))
    at = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("max_speed") - F.col("low"), width)), F.lit(bins - 1)))
    placed = counted.withColumn("_span", span).select("max_speed", "n", "_span.*").select(at.cast("int").alias("bin"), "low", width.alias("width"), "n")
    return placed.groupBy("bin").agg(
        F.round(F.first(F.col("low") + F.col("bin") * F.col("width")), 4).alias("bin_start"),
        F.round(F.first(F.col("low") + (F.col("bin") + 1) * F.col("width")), 4).alias("bin_end"),
        F.sum("n").alias("count"))


def speed_band(speed: Column) -> Column:
    """Bands are open below and closed above, so a speed of 0 is in none."""
    out = F.lit(None).cast("string")
    for low, high, label in BANDS:
        test = speed > low if high is None else (speed > low) & (speed <= high)
        out = F.when(test, F.lit(label)).otherwise(out)
    return out


def speed_bands(vehicles: DataFrame) -> DataFrame:
    banded = vehicles.select(speed_band(F.col("max_speed")).alias("speed_category"), "vehicle_type")
    return banded.dropna().groupBy("speed_category", "vehicle_type").agg(_rows().alias("count"))


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def speed_box(vehicles: DataFrame, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> DataFrame:
    """Quartiles per type and the last values inside 1.5 times the box; equal speeds are counted first.

    A type with very many different speeds is cut into ranges of speed, whose counts tell the ranks, so no task holds its speeds.
    """
    counted = vehicles.dropna(subset=["vehicle_type", "max_speed"]).groupBy("vehicle_type", "max_speed").agg(_rows().alias("n"))
    cold, hot = split_hot(counted, ["vehicle_type"], hot_rows)
    whole = [F.min("max_speed").alias("lowest"), F.max("max_speed").alias("highest"), F.sum("n").alias("vehicles")]
    boxes = cold.groupBy("vehicle_type").agg(*[F.percentile("max_speed", F.lit(p), F.col("n")).alias(q) for q, p in QUARTILES.items()], *whole)
    if hot is not None:
        boxes = boxes.unionByName(_by_rank(hot, hot.groupBy("vehicle_type").agg(*whole), ranges))
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    inside = F.col("max_speed").between(F.col("q1") - reach, F.col("q3") + reach)
    fences = counted.join(boxes, "vehicle_type").groupBy("vehicle_type").agg(
        F.min(F.when(inside, F.col("max_speed"))).alias("lower_fence"),
        F.max(F.when(inside, F.col("max_speed"))).alias("upper_fence"))
    return boxes.join(fences, "vehicle_type")


def _by_rank(counted: DataFrame, whole: DataFrame, ranges: int | None) -> DataFrame:
    """Exact quartiles, between two neighbours in proportion: the first speeds whose running count goes beyond their ranks."""
    placed = scan_ranges(counted, ["vehicle_type"], ["max_speed"], sums={"_upto": F.col("n")}, ranges=ranges)
    named = whole.withColumnRenamed("vehicle_type", "_type")
    ranked = placed.join(named, F.col("vehicle_type") == F.col("_type"))
    at = {q: (F.col("vehicles") - 1) * F.lit(p) for q, p in QUARTILES.items()}

    def beyond(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("max_speed")))

    found = ranked.groupBy("vehicle_type").agg(
        *[beyond(f(x)).alias(f"_{q}_{name}") for q, x in at.items() for name, f in (("low", F.floor), ("high", F.ceil))])
    joined = found.join(named, F.col("vehicle_type") == F.col("_type"))

    def value(q: str) -> Column:
        low, high = F.col(f"_{q}_low").cast("double"), F.col(f"_{q}_high").cast("double")
        return F.when(low == high, low).otherwise((F.ceil(at[q]) - at[q]) * low + (at[q] - F.floor(at[q])) * high)

    return joined.select("vehicle_type", *[value(q).alias(q) for q in QUARTILES], "lowest", "highest", "vehicles")


def _usable_heading() -> Column:
    return F.coalesce((F.col("direction") != "") & (F.col("direction") != "unknown"), F.lit(False))


def _usable_time() -> Column:
    return F.coalesce(F.col("timestamp") > 0, F.lit(False))


def valid_guard(events: DataFrame) -> DataFrame:
    """Whether any sighting has a usable direction, and any a usable time."""
    return events.agg(F.coalesce(F.max(_usable_heading()), F.lit(False)).alias("has_direction"),
                      F.coalesce(F.max(_usable_time()), F.lit(False)).alias("has_time"))


def frame_bucket(frame: Column, size: int = FPS) -> Column:
    """Nearest multiple of ``size``; halves go to the even multiple."""
    return (F.bround(frame / F.lit(float(size)), 0) * size).cast("long")


def direction_over_time(events: DataFrame) -> DataFrame:
    """All headings per bucket of frames, provided that some heading in the table is usable."""
    counted = (
        events.filter(F.col("direction").isNotNull())
        .groupBy(frame_bucket(F.col("frame_id")).alias("frame_interval"), "direction").agg(_rows().alias("count")))
    return counted.filter(counted.agg(F.max(_usable_heading())).scalar())


def flow_over_time(events: DataFrame) -> DataFrame:
    return events.groupBy("frame_id").agg(_rows().alias("vehicle_count"))


def speed_over_time(events: DataFrame) -> DataFrame:
    return events.groupBy("frame_id").agg(F.round(F.avg("estimated_speed_kmh"), 4).alias("avg_speed"))


def trend(flow: DataFrame, x: str = "frame_id", y: str = "vehicle_count") -> DataFrame:
    """Straight line through the points, as one row; no row for fewer than three points.

    Points that all have one value fit perfectly.
    """
    a, c = F.col(x).cast("double"), F.col(y).cast("double")
    line = flow.agg(
        F.regr_slope(c, a).alias("slope"), F.regr_intercept(c, a).alias("intercept"),
        F.regr_r2(c, a).alias("r2"), _rows().alias("points"),
        F.min(x).alias("first_x"), F.max(x).alias("last_x"))
    return line.filter(F.col("points") >= 3)


def forecast(events: DataFrame, share: float = FORECAST_SHARE, stride: int = 10_000) -> DataFrame:
    """Counts per frame, followed by the line carried on for a quarter of the span and one frame at least.

    Sightings are read once, for the counts; the line and the check of the times are taken from those.
    Future frames are laid out in strides that spread over the tasks.
    """
    flow = events.groupBy("frame_id").agg(_rows().alias("vehicle_count"), F.max(_usable_time()).alias("_timed"))
    line = trend(flow).filter(flow.agg(F.max("_timed")).scalar())
    steps = F.greatest(F.lit(1).cast("long"), ((F.col("last_x") - F.col("first_x")) * F.lit(share)).cast("long"))
    bounds = line.select("slope", "intercept", (F.col("last_x") + 1).alias("_from"), (F.col("last_x") + steps).alias("_to"))
    strides = bounds.withColumn("_at", F.explode(F.expr(f"sequence(_from, _to, {stride}L)"))).repartition("_at")
    ahead = strides.withColumn(
        "frame_id", F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + F.lit(stride - 1), F.col("_to")))))
    future = ahead.select("frame_id", (F.col("intercept") + F.col("slope") * F.col("frame_id")).alias("vehicle_count"),
                          F.lit("Forecast").alias("type"))
    past = flow.filter(line.select("points").scalar().isNotNull()).select(
        "frame_id", F.col("vehicle_count").cast("double").alias("vehicle_count"), F.lit("Historical").alias("type"))
    return past.unionByName(future)


# Speed from positions

def _speed(now: Column, start: Column, seen: Column, fps: int, least: int) -> Column:
    distance = F.abs(now - start).cast("double")
    return F.when(seen < least, F.lit(0)).otherwise((distance / (seen / F.lit(float(fps))) * F.lit(3.6)).cast("long")).cast("long")


def trailing_speed(events: DataFrame, keys: Sequence[str] = ("video_id", "car_id"), order: Sequence[str] = ("event_id",),
                   position: str = "position_y", buffer: int = BUFFER, fps: int = FPS, least: int = MIN_SIGHTINGS,
                   hot_rows: int = HOT_ROWS, ranges: int | None = None, sized: DataFrame | None = None) -> DataFrame:
    """Speed from the last ``buffer`` positions of a vehicle: way from first to last over their number of frames.

    A vehicle with very many sightings is cut into ranges; each range is led in by the positions just before it.
    """
    cold, hot = split_hot(events, keys, hot_rows, sized)
    line = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(buffer - 1), 0)
    plain = cold.withColumn("speed", _speed(
        F.col(position), F.first(position).over(line), F.count(F.lit(1)).over(line), fps, least))
    if hot is None:
        return plain
    return plain.unionByName(_speed_in_ranges(hot, keys, order, position, buffer, fps, least, ranges))


def _speed_in_ranges(events, keys, order, position, buffer, fps, least, ranges) -> DataFrame:
    cut = with_ranges(events, keys, order, ranges)
    latest = Window.partitionBy(*keys, "_range").orderBy(*[F.col(c).desc() for c in order])
    item = F.struct(*[F.col(c) for c in order], F.col(position))
    tails = (
        cut.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") < buffer)
        .groupBy(*keys, "_range").agg(F.array_sort(F.collect_list(item)).alias("_tail")))
    # Every range that exists holds a row, so the rows wanted lie in the buffer-1 ranges before.
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(-(buffer - 1), -1)
    led = tails.withColumn("_lead", F.flatten(F.collect_list("_tail").over(before)))
    size = F.size("_lead")
    wanted = F.slice("_lead", F.greatest(size - (buffer - 2), F.lit(1)), F.lit(buffer - 1))
    lead = led.select(*keys, "_range", F.explode(wanted).alias("_item")).select(
        *keys, "_range", "_item.*", F.lit(True).alias("_is_lead"))
    rows = cut.withColumn("_is_lead", F.lit(False)).unionByName(lead, allowMissingColumns=True)
    line = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(-(buffer - 1), 0)
    scored = rows.withColumn("speed", _speed(
        F.col(position), F.first(position).over(line), F.count(F.lit(1)).over(line), fps, least))
    return scored.filter(~F.col("_is_lead")).select(*events.columns, "speed")


# Questions

def average_speed(events: DataFrame) -> DataFrame:
    total = F.sum("estimated_speed_kmh").cast("double") / F.count("estimated_speed_kmh")
    return events.agg(F.round(total, 4).alias("avg_speed"))


def fastest_vehicle(events: DataFrame, order: str = "event_id") -> DataFrame:
    """The sighting with the highest speed; the earliest of equals."""
    rank = F.struct(F.col("estimated_speed_kmh"), -F.col(order))
    best = events.agg(F.max_by(F.struct(*events.columns), rank).alias("best"))
    return best.select("best.*")


def max_per_entity(events: DataFrame, group: str, entity: str, kind: str, wanted: str) -> DataFrame:
    """Highest number of events of one kind that an entity has in a group."""
    counted = events.filter(F.col(kind) == wanted).groupBy(group, entity).agg(_rows().alias("n"))
    return counted.agg(F.max("n").alias("max_events"))


def average_per_entity(events: DataFrame, entity: str) -> DataFrame:
    total = F.sum("estimated_speed_kmh").cast("double") / F.count("estimated_speed_kmh")
    return events.groupBy(entity).agg(F.round(total, 4).alias("avg_speed"))


def distinct_values(events: DataFrame, column: str) -> DataFrame:
    return events.select(column).distinct()


def weekly_share(events: DataFrame, team: str, moment: str) -> DataFrame:
    """Share of each team in the events of a day, in percent, averaged over the days of a week."""
    daily = events.groupBy(F.date_trunc("day", F.col(moment)).alias("day"), team).agg(_rows().alias("n"))
    whole = daily.groupBy("day").agg(F.sum("n").alias("all_events"))
    share = daily.join(whole, "day").withColumn("share", F.col("n") * F.lit(100.0) / F.col("all_events"))
    week = F.date_trunc("week", F.col("day")).cast("date").alias("week")
    return share.groupBy(week, team).agg(F.round(F.avg("share"), 4).alias("avg_share"))
