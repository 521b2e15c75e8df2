"""Model runs: keys, cycles, forecast hours and valid times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The models' keys.
MODELS = ("gfs", "nam", "nam3km", "hrrr")
MODEL_SCHEMA = "model string, last int, step int"


def model_key(text: Column) -> Column:
    """A model's key from its name in any case, with blanks around; missing for an unknown one."""
    key = F.lower(F.trim(text))
    return F.when(key.isin(*MODELS), key)


def known_model(text: Column) -> Column:
    """The same, but an unknown name is an error."""
    return F.coalesce(model_key(text), F.raise_error(F.concat(F.lit("unknown model: "), F.coalesce(text, F.lit("null")))).cast("string"))


def run_id(day: Column, cycle: Column) -> Column:
    """YYYYMMDD-HH00Z of a day (YYYYMMDD) and a cycle hour."""
    return F.concat(F.substring(day, 1, 8), F.lit("-"), F.lpad(cycle.cast("string"), 2, "0"), F.lit("00Z"))


def valid_time(day: Column, cycle: Column, hour: Column) -> Column:
    """The time that a forecast hour of a run is valid for, as YYYY-MM-DDTHH:MM:SSZ."""
    at = F.to_timestamp_ntz(F.substring(day, 1, 8), F.lit("yyyyMMdd")) + F.make_dt_interval(hours=(cycle + hour).cast("int"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def full_hours(models: DataFrame) -> DataFrame:
    """model, hour: every hour of a full run; models: model, last, step (hours, at least 1)."""
    hours = F.sequence(F.lit(0).cast("bigint"), F.col("last").cast("bigint"), F.greatest(F.col("step"), F.lit(1)).cast("bigint"))
    return models.where("last >= 0").select("model", F.explode(hours).alias("hour"))


def parse_hours(requests: DataFrame, text: str) -> DataFrame:
    """``requests`` with one row for each distinct hour that a comma list names.

    Numbers are rounded with halves up; a blank item counts as 0, negative ones and
    words are left out. Requests without any hour give no row.
    """
    item = F.trim(F.col("item"))
    number = F.when(item == "", 0.0).otherwise(F.expr("try_cast(trim(item) AS double)"))
    rows = requests.withColumn("item", F.explode(F.split(F.col(text), ","))).withColumn("number", number)
    return rows.where("number >= 0").withColumn("hour", F.floor(F.col("number") + 0.5).cast("bigint")).drop("item", "number", text).distinct()


def check_hours(hours: DataFrame, models: DataFrame) -> DataFrame:
    """``hours`` (model, hour); an hour beyond its model's last one is an error."""
    rows = hours.join(F.broadcast(models.select("model", "last")), "model", "left")
    beyond = F.concat(F.col("model"), F.lit(" has no forecast hour "), F.col("hour").cast("string"))
    return rows.withColumn("hour", F.when(F.col("hour") > F.col("last"), F.raise_error(beyond).cast("bigint")).otherwise(F.col("hour"))).drop("last")


def metadata(runs: DataFrame) -> DataFrame:
    """One row a run (model, day, cycle, hours: an array) with run_id, reference_time and valid_times."""
    times = F.transform("hours", lambda h: valid_time(F.col("day"), F.col("cycle"), h))
    return runs.withColumns({"run_id": run_id(F.col("day"), F.col("cycle")), "reference_time": valid_time(F.col("day"), F.col("cycle"), F.lit(0)), "valid_times": times})
