"""Synthetic bookings.

Every draw is arithmetic on (row id, field, seed). A lost task therefore makes the same rows
again, and the data does not depend on how it is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.tables import SEED_ROWS

# Fixed values of the generator; the names of people are our own.
STATUSES = ["Scheduled", "Boarding", "Departed", "Arrived", "Delayed", "Cancelled"]
AIRCRAFT_TYPES = ["Boeing 737", "Boeing 777", "Airbus A320", "Airbus A380", "Boeing 787"]
FIRST_NAMES = ["Ada", "Boris", "Chloe", "Dmitri", "Elif", "Farid", "Greta", "Hugo", "Ines", "Jonas", "Kaya", "Lars", "Mina",
               "Noor", "Otto"]
LAST_NAMES = ["Abel", "Brandt", "Costa", "Duval", "Ekman", "Ferrari", "Grau", "Holm", "Ivanov", "Jensen", "Kowalski",
              "Lindt", "Moreau"]
SEXES = ["Male", "Female"]
CLASSES = ["Economy", "Business", "First Class"]
SEAT_LETTERS = ["A", "B", "C", "D", "E", "F"]
PRICE_RANGES = {"Economy": (150, 800), "Business": (1200, 3500), "First Class": (3500, 8000)}


FIELDS = ("airline", "origin", "step", "days", "hours", "status", "aircraft", "length", "luck", "minor", "major",
          "first", "last", "class", "price", "passport", "exchange", "line", "sex", "flight", "row", "seat", "booked")
PRIME = 2**31 - 1


def draw_constants(field: str, seed: int) -> tuple[int, int]:
    """Factor and offset of a field: powers of primitive roots of the prime."""
    place = FIELDS.index(field)
    return pow(16807, place + 2, PRIME), (pow(48271, place + 3, PRIME) + 69621 * seed) % PRIME


def draw(row_id: Column, field: str, seed: int, size: int) -> Column:
    """A whole number in [0, size) that depends on the row, the field and the seed alone.

    Both halves of the 64-bit id are scrambled by a line each and together by two squares modulo a prime, which stays
    within 63 bits.
    """
    factor, offset = draw_constants(field, seed)
    prime, shift = F.lit(PRIME), F.lit(offset)
    low, high = F.pmod(row_id.cast("long"), prime), F.pmod(F.floor(row_id.cast("long") / prime), prime)
    mixed = (low * F.lit(factor) % prime + high * F.lit(factor * 69621 % PRIME) % prime + shift) % prime
    mixed = (mixed * mixed + shift) % prime
    mixed = (mixed * mixed + shift) % prime
    return mixed % size


def pick(row_id: Column, field: str, seed: int, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (draw(row_id, field, seed, len(values)) + 1).cast("int"))


def between(row_id: Column, field: str, seed: int, low: int, high: int) -> Column:
    """Inclusive at both ends."""
    return draw(row_id, field, seed, high - low + 1) + low


def flight_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "flight_id")


def generate_flights(ids: DataFrame, seed: int = 7, now: str = "2024-01-31 00:00:00") -> DataFrame:
    """One flight per ``flight_id``: destination is never the origin, arrival 2 to 12 hours after
    departure, and the delay follows the status."""
    codes = [row[0] for row in SEED_ROWS["airports"]]
    carriers = [row[0] for row in SEED_ROWS["airlines"]]
    key = F.col("flight_id")
    start = draw(key, "origin", seed, len(codes))
    # A step of 1 .. n-1 around the circle of airports cannot come back to the origin.
    stop = (start + between(key, "step", seed, 1, len(codes) - 1)) % len(codes)
    airports = F.array(*[F.lit(c) for c in codes])
    base = ids.select(
        key,
        pick(key, "airline", seed, carriers).alias("airline"),
        F.element_at(airports, (start + 1).cast("int")).alias("origin"),
        F.element_at(airports, (stop + 1).cast("int")).alias("destination"),
        (F.lit(now).cast("timestamp_ntz") + F.make_dt_interval(
            between(key, "days", seed, -30, 30).cast("int"), between(key, "hours", seed, 0, 23).cast("int")
        )).alias("departure_time"),
        pick(key, "status", seed, STATUSES).alias("status"),
        pick(key, "aircraft", seed, AIRCRAFT_TYPES).alias("aircraft_type"),
    )
    minor = F.when(draw(key, "luck", seed, 100) < 70, F.lit(0)).otherwise(between(key, "minor", seed, 5, 60))
    delay = (
        F.when(F.col("status").isin("Delayed", "Cancelled"), between(key, "major", seed, 15, 240))
        .when(F.col("status").isin("Departed", "Arrived"), minor)
        .otherwise(F.lit(0))
    )
    return base.select(
        "flight_id",
        F.concat("airline", (key + 1000).cast("string")).alias("flight_number"),
        "airline", "origin", "destination", "departure_time",
        (F.col("departure_time") + F.make_dt_interval(hours=between(key, "length", seed, 2, 12).cast("int")))
        .alias("arrival_time"),
        "status", "aircraft_type",
        delay.cast("int").alias("delay_minutes"),
    )


def generate_passengers(ids: DataFrame, n_flights: int, seed: int = 7, now: str = "2024-01-31 00:00:00") -> DataFrame:
    """One passenger per ``row_id``, on one of ``n_flights`` flights, priced by class."""
    key = F.col("row_id")
    base = ids.select(
        key,
        pick(key, "first", seed, FIRST_NAMES).alias("first_name"),
        pick(key, "last", seed, LAST_NAMES).alias("last_name"),
        pick(key, "class", seed, CLASSES).alias("class"),
    )
    price = F.lit(None).cast("long")
    for name, (low, high) in PRICE_RANGES.items():
        price = F.when(F.col("class") == name, between(key, "price", seed, low, high)).otherwise(price)
    return base.select(
        F.concat(F.lit("P"), between(key, "passport", seed, 100000, 999999).cast("string")).alias("passport_id"),
        "first_name", "last_name",
        F.concat(F.lower("first_name"), F.lit("."), F.lower("last_name"), key.cast("string"), F.lit("@email.com"))
        .alias("email"),
        F.concat(F.lit("+1-555-"), between(key, "exchange", seed, 100, 999).cast("string"), F.lit("-"),
                 between(key, "line", seed, 1000, 9999).cast("string")).alias("phone"),
        pick(key, "sex", seed, SEXES).alias("sex"),
        between(key, "flight", seed, 1, n_flights).alias("flight_id"),
        F.concat(between(key, "row", seed, 1, 30).cast("string"), pick(key, "seat", seed, SEAT_LETTERS))
        .alias("seat_number"),
        "class",
        (F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=between(key, "booked", seed, 1, 60).cast("int")))
        .alias("booking_date"),
        price.cast("decimal(10,2)").alias("ticket_price"),
    )
