"""Two made-up tables to try the analysis on, with effects that it should find.

Every cell is a function of its row's number, so a table is the same in every run and
on any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _chance(name: str) -> Column:
    """Evenly spread over [0, 1), by row and name."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(name), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _bell(name: str) -> Column:
    """About normal with deviation 1: twelve even draws less their mean."""
    out = F.lit(-6.0)
    for i in range(12):
        out = out + _chance(f"{name}.{i}")
    return out


def _one_of(name: str, options: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in options]), F.floor(_chance(name) * len(options)).cast("int"))


def _added(column: str, **by: float) -> Column:
    """What a level adds; 0 for levels that are not named."""
    out = F.lit(0.0)
    for level, plus in by.items():
        out = out + F.when(F.col(f"`{column}`") == level, plus).otherwise(0.0)
    return out


def workshop(spark: SparkSession, rows: int = 900) -> DataFrame:
    """Jobs of a bicycle workshop.

    Planted: the hours of a job follow the kind of bike and its motor, its cost follows
    hours and parts; wear follows the way ridden; satisfaction falls with the days of waiting; one
    shop has nearly all cargo bikes; a few jobs cost many times the usual.
    """
    kinds, shops = ("City", "Road", "Mountain", "Cargo", "Folding"), ("Harbour", "Station", "Old Town", "Hillside")
    jobs = spark.range(rows)
    jobs = jobs.withColumn("Job ID", F.format_string("J-%05d", F.col("id") * 7 + 11))
    jobs = jobs.withColumn("Received", F.date_add(F.lit("2031-03-03"), F.floor(_chance("day") * 280).cast("int")))
    jobs = jobs.withColumn("Bike Kind", _one_of("kind", kinds)).withColumn("Frame", _one_of("frame", ("Steel", "Alloy", "Carbon")))
    jobs = jobs.withColumn("Motor", F.when(_chance("motor") < F.when(F.col("Bike Kind") == "Cargo", 0.9).otherwise(0.25), "yes").otherwise("no"))
    jobs = jobs.withColumn("Shop", F.when((F.col("Bike Kind") == "Cargo") & (_chance("moved") < 0.85), "Harbour").otherwise(_one_of("shop", shops)))
    jobs = jobs.withColumn("Mechanic", _one_of("mechanic", ("Ada", "Bo", "Cem", "Dina", "Eli", "Fay")))
    jobs = jobs.withColumn("Urgency", _one_of("urgency", ("Low", "Medium", "High")))
    jobs = jobs.withColumn("Booked Online", F.when(_chance("online") < 0.6, "yes").otherwise("no"))
    jobs = jobs.withColumn("Kilometres Ridden", F.round(150.0 + 9000.0 * _chance("way") * _chance("way too")))
    jobs = jobs.withColumn("Wear", F.round(2.0 + 0.004 * F.col("Kilometres Ridden") + 2.5 * _bell("wear"), 1))
    jobs = jobs.withColumn("Parts Fitted", F.floor(1.0 + 6.0 * _chance("parts")))
    hours = 1.5 + _added("Bike Kind", Cargo=2.25, Mountain=0.75) + _added("Motor", yes=1.75) + 0.2 * F.col("Parts Fitted") + 0.35 * _bell("hours")
    jobs = jobs.withColumn("Labour Hours", F.round(F.greatest(F.lit(0.25), hours), 2))
    jobs = jobs.withColumn("Parts Spend", F.round(F.col("Parts Fitted") * (14.0 + _added("Frame", Carbon=23.0, Alloy=4.0)) + 5.0 * _chance("spend"), 2))
    jobs = jobs.withColumn("Waiting Days", F.greatest(F.lit(0.0), F.round(6.0 + _added("Urgency", High=-4.0, Low=3.0) + 1.5 * _bell("wait"))))
    jobs = jobs.withColumn("Satisfaction", F.round(9.0 - 0.45 * F.col("Waiting Days") + 0.6 * _bell("mood"), 1))
    odd = F.when(F.col("id") % 181 == 90, 9.0).otherwise(1.0)
    jobs = jobs.withColumn("Job Revenue", F.round(odd * (52.0 * F.col("Labour Hours") + 1.3 * F.col("Parts Spend") + 9.0 * _bell("bill")), 2))
    return jobs.drop("id")


def hires(spark: SparkSession, rows: int = 520) -> DataFrame:
    """Bikes hired at four stations by day.

    Planted: a rise over the whole span, weekends above weekdays, rain below sun, and
    income that follows the hires.
    """
    stations = ("Lake", "Market", "Museum", "Park")
    day = F.floor(F.col("id") / len(stations)).cast("int")
    out = spark.range(rows).withColumn("Day", F.date_add(F.lit("2030-05-06"), day)).withColumn("Station", F.get(F.array(*[F.lit(s) for s in stations]), (F.col("id") % len(stations)).cast("int")))
    out = out.withColumn("Weather", _one_of("weather", ("Sun", "Cloud", "Rain")))
    level = 40.0 + 0.3 * day + F.when(F.dayofweek("Day").isin(1, 7), 25.0).otherwise(0.0) + _added("Weather", Sun=12.0, Rain=-15.0) + _added("Station", Lake=18.0, Park=6.0)
    out = out.withColumn("Hires", F.greatest(F.lit(0.0), F.round(level + 4.0 * _bell("hires"))))
    return out.withColumn("Income", F.round(3.75 * F.col("Hires") + 6.0 * _bell("income"), 2)).withColumn("Broken Bikes", F.floor(4.0 * _chance("broken"))).drop("id")
