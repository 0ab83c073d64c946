"""The geography of a municipal register: states, regions, districts, associations and municipalities, with names of all levels,
figures rolled up, and postal codes.

A register has one row for each unit and postal code: record (10 state, 40 district, 50 association, 60 municipality), the parts of
its key land, rb, kreis, vb, gem, name, figures, plz, and pos, its place in the file. Every municipality is in one state; the levels
between may lack rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marktlens.functions.text import padded_plz
from marktlens.operators import joins

KEYS = ["land", "rb", "kreis", "vb", "gem"]
#: What a municipality takes from its rows: of each column the first value that isn't null.
FACTS = ["name", "area_km2", "pop_total", "pop_male", "pop_female", "pop_density", "lon", "lat", "urban_code", "urban_name", "travel_code", "travel_name"]
#: Levels above the municipalities: name of the table, length of its key, and which rows define it.
LEVELS = [("states", 1, "record = 10"), ("regions", 2, "rb <> 0"), ("districts", 3, "record = 40"), ("subdistricts", 4, "record = 50")]


def typed(rows: DataFrame) -> DataFrame:
    """A register of texts with its numbers as such; what is no number is null, and rows without a record type go."""
    numbers = {"record": "int", **dict.fromkeys(KEYS, "int"), "area_km2": "double", "pop_density": "double", "lon": "double", "lat": "double", **dict.fromkeys(["pop_total", "pop_male", "pop_female"], "long")}
    made = rows.select(*[F.trim(c).try_cast("double").cast(numbers[c]).alias(c) if c in numbers else F.col(c) for c in rows.columns])
    return made.filter("record is not null")


def unit_id() -> Column:
    """The parts of a municipality's key as one number, in the order of the keys."""
    return (((F.col("land").cast("long") * 10 + F.col("rb")) * 100 + F.col("kreis")) * 10_000 + F.col("vb")) * 1000 + F.col("gem")


def units(register: DataFrame, depth: int, rows: str) -> DataFrame:
    """The first row of each unit of a level, by record type and place in the file."""
    first = F.min_by(F.struct("name", "area_km2", "pop_total"), F.struct("record", "pos"))
    return register.filter(rows).dropna(subset=KEYS[:depth]).groupBy(*KEYS[:depth]).agg(first.alias("u")).select(*KEYS[:depth], "u.*")


def municipalities(register: DataFrame) -> DataFrame:
    """One row for each municipality: its facts, and its postal codes in order as plz_list."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in FACTS]
    codes = F.array_sort(F.collect_set(padded_plz(F.col("plz").cast("string"))))
    rows = register.filter("record = 60").dropna(subset=KEYS)
    return rows.groupBy(*KEYS).agg(*first, codes.alias("plz_list")).withColumn("id", unit_id())


def named(cities: DataFrame, levels: dict[str, DataFrame]) -> DataFrame:
    """Municipalities with the names of the units above them; a unit without a row of its own is called by its level and number. vb 0 is
    no association."""
    for (table, depth, _), label, call in zip(LEVELS, ("state_name", "region_name", "district_name", "subdistrict_name"), ("Land ", "RB ", "Kreis ", "VB ")):
        by = KEYS[:depth]
        cities = cities.join(levels[table].select(*by, F.col("name").alias("_name")), by, "left")
        given = F.coalesce("_name", F.concat(F.lit(call), F.col(by[-1]).cast("string")))
        cities = cities.withColumn(label, F.when(F.col("vb") != 0, given) if by[-1] == "vb" else given).drop("_name")
    return cities


def rolled_up(cities: DataFrame) -> DataFrame:
    """Area and population of all four levels in one pass: depth (the length of the key) and sums; null parts are above the level."""
    sets = [[F.col(k) for k in KEYS[:depth]] for _, depth, _ in LEVELS]
    sums = cities.select(*KEYS[:4], "area_km2", "pop_total").groupingSets(sets, *KEYS[:4]).agg(F.grouping_id().alias("_g"), F.sum("area_km2").alias("area_km2"), F.sum("pop_total").alias("pop_total"))
    # the grouping id has a bit for each part that the level lacks
    return sums.withColumn("depth", F.lit(4) - F.bit_count("_g")).drop("_g")


def with_sums(level: DataFrame, depth: int, sums: DataFrame) -> DataFrame:
    """Units with the sums of their municipalities in place of their own figures; those without municipalities keep theirs."""
    by = KEYS[:depth]
    own = sums.filter(F.col("depth") == depth).select(*by, F.col("area_km2").alias("_area"), F.col("pop_total").alias("_pop"), F.lit(True).alias("_in"))
    figure = lambda own, new: F.when(F.col("_in"), F.col(new)).otherwise(F.col(own)).alias(own)
    return level.join(own, by, "left").select(*by, "name", figure("area_km2", "_area"), figure("pop_total", "_pop"))


def with_codes(cities: DataFrame, points: DataFrame) -> DataFrame:
    """Each postal code (plz, lat, lon) goes to the nearest municipality; those that get any have these as their plz_list, in order,
    the others keep theirs. A code with several points may go to several; municipalities without coordinates get none."""
    at = points.select(F.struct("plz", "lat", "lon").alias("id"), "lat", "lon")
    near = joins.nearest(at, cities.filter("lat is not null and lon is not null").select("id", "lat", "lon"))
    codes = near.groupBy(F.col("place_id").alias("id")).agg(F.array_sort(F.collect_set("point_id.plz")).alias("_codes"))
    return cities.join(codes, "id", "left").withColumn("plz_list", F.coalesce("_codes", "plz_list")).drop("_codes")


def build(register: DataFrame, points: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five tables of a register: states, regions, districts, subdistricts, cities; points: postal codes to attach."""
    levels = {table: units(register, depth, rows) for table, depth, rows in LEVELS}
    cities = named(municipalities(register), levels)
    sums = rolled_up(cities)
    if points is not None:
        cities = with_codes(cities, points)
    return {table: with_sums(levels[table], depth, sums) for table, depth, _ in LEVELS} | {"cities": cities}
