"""Domain tables from the star-schema test tables, for Spark (tables()) and as SQL text (PRELUDE)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400
#: Bytes of files for each task of the shuffle of line items by order.
TASK_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows dealt by a key, over as many tasks as the bytes of the file ask for, no fewer than the session's."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES)), key)


def epoch(c: str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


class Tables:
    """Lazily built domain tables of one folder. Each is a plan; nothing runs here."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    @property
    def metrics(self) -> DataFrame:
        """activity_metrics: one row for each order that has line items."""
        sums = self.raw("lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("e"), F.sum("l_quantity").alias("q"))
        o = self.raw("orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
        p = F.col("o_orderpriority")
        sport = F.when(p == "1-URGENT", "Ride").when(p == "2-HIGH", "Run").when(p == "3-MEDIUM", "Swim").when(p == "4-NOT SPECIFIED", "WeightTraining").otherwise("Hike")
        return o.select(
            F.col("o_orderkey").alias("activity_id"), epoch("o_orderdate").alias("date"), sport.alias("sport_type"),
            F.round(F.col("e") / 10, 3).alias("distance"), (F.col("q") * 60).cast("long").alias("moving_time"),
            F.round(F.col("o_totalprice") / 1000, 5).alias("training_load"), (100 + F.col("o_custkey") % 80).alias("avg_hr"),
            F.when(F.col("o_custkey") % 9 != 0, 200 + F.col("o_custkey") % 100).alias("ftp"), F.col("o_custkey").alias("route_id"),
            F.when(F.col("o_orderstatus") == "O", "reverse").when(F.col("o_orderstatus") == "P", "backward").otherwise("same").alias("direction"),
            F.concat(F.lit("Activity "), F.col("o_orderkey").cast("string")).alias("name"),
        )

    @property
    def activities(self) -> DataFrame:
        """Metadata with a bounding box near 46 N, 7 E."""
        lat, lng = 46 + (F.col("activity_id") % 997) / 1000.0, 7 + (F.col("route_id") % 499) / 500.0
        return self.metrics.select(
            "activity_id", "sport_type", F.when(F.col("activity_id") % 11 != 0, F.col("date")).alias("start_date"), "name",
            F.col("distance").alias("distance_meters"), F.col("moving_time").alias("duration_secs"),
            lat.alias("min_lat"), (lat + 0.05).alias("max_lat"), lng.alias("min_lng"), (lng + 0.05).alias("max_lng"),
        )

    @property
    def sections(self) -> DataFrame:
        return self._sections(self.raw("part"))

    @staticmethod
    def _sections(part: DataFrame) -> DataFrame:
        sport = F.when(F.col("p_size") % 3 == 0, "Ride").when(F.col("p_size") % 3 == 1, "Run").otherwise("Hike")
        return part.select(
            F.col("p_partkey").alias("section_id"), F.when(F.col("p_partkey") % 5 == 0, "custom").otherwise("auto").alias("section_type"),
            F.when(F.col("p_partkey") % 7 != 0, F.concat(sport, F.lit(" Section "), F.col("p_partkey").cast("string"))).alias("name"),
            sport.alias("sport_type"), (F.col("p_size") * 100.0).alias("section_meters"), (F.col("p_partkey") % 17 == 0).alias("disabled"),
            F.when(F.col("p_partkey") % 23 == 0, F.col("p_partkey") - 1).alias("superseded_by"),
            (46 + (F.col("p_partkey") * 37 % 1000) / 2000.0).alias("lat"), (7 + (F.col("p_partkey") * 91 % 1000) / 2000.0).alias("lng"),
        )

    @property
    def section_points(self) -> DataFrame:
        """Polylines of the sections: a point every 100 m, northward or eastward. A small file is dealt over all tasks before it grows."""
        k = F.col("point") * 100 / 111_194.9
        s = self._sections(dealt(self.raw("part"), f"{self.sf_dir}/part.parquet", "p_partkey")).select("section_id", "lat", "lng", F.explode(F.sequence(F.lit(0), (F.col("section_meters") / 100).cast("int"))).alias("point"))
        return s.select("section_id", "point", (F.col("lat") + F.when(F.col("section_id") % 2 == 0, k).otherwise(0.0)).alias("lat"), (F.col("lng") + F.when(F.col("section_id") % 2 == 0, 0.0).otherwise(k)).alias("lng"))

    @property
    def traversals(self) -> DataFrame:
        """section_activities, unique by section, activity and start_index.

        Dealt by activity before they are made unique: joins with activities
        and groups that hold the activity need no further shuffle.
        """
        x = dealt(self.raw("lineitem"), f"{self.sf_dir}/lineitem.parquet", "l_orderkey").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(
            F.max("l_returnflag").alias("f"), F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("e"), F.max("l_suppkey").alias("s"),
            F.max("l_discount").alias("d"), F.max("l_tax").alias("t"),
        )
        lap = F.when(F.col("s") % 7 != 0, F.round(F.col("e") / 10, 3))
        return x.select(
            F.col("l_partkey").alias("section_id"), F.col("l_orderkey").alias("activity_id"), F.col("l_linenumber").alias("start_index"),
            F.when(F.col("f") == "R", "reverse").when(F.col("f") == "A", "partial").otherwise("same").alias("direction"),
            (F.col("q") * 100.0).alias("distance_meters"), lap.alias("lap_time"), F.round(F.col("q") * 100.0 / lap, 6).alias("lap_pace"),
            F.round(110 + 100 * F.col("d"), 2).alias("avg_hr"), (F.col("t") > 0.07).alias("excluded"),
        )

    @property
    def wellness(self) -> DataFrame:
        x = self.raw("events").groupBy(F.to_date("ts").alias("date")).agg(
            F.avg("value").alias("c"), F.max("value").alias("m"), F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("h"), F.count(F.lit(1)).alias("n")
        )
        return x.select(
            F.date_format("date", "yyyy-MM-dd").alias("date"), F.round("c", 4).alias("ctl"), F.round(F.col("m") / 5, 4).alias("atl"),
            F.when(F.dayofmonth("date") % 4 != 0, F.round("h", 4)).alias("hrv"), F.round(50 + F.col("n") % 13, 1).alias("resting_hr"),
        )

    @property
    def exercise_sets(self) -> DataFrame:
        x = dealt(self.raw("lineitem"), f"{self.sf_dir}/lineitem.parquet", "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))
        return x.select(
            F.col("l_orderkey").alias("activity_id"), F.col("l_linenumber").alias("set_order"), (F.col("p") % 35).cast("int").alias("exercise_category"),
            F.when(F.col("l_linenumber") % 4 == 0, 1).otherwise(0).alias("set_type"), F.when(F.col("q").cast("int") % 5 != 0, F.col("q").cast("int")).alias("repetitions"),
            F.round(F.col("d") * 100, 2).alias("weight_kg"),
        )

    @property
    def points(self) -> DataFrame:
        """GPS fixes of each user in order of time, with seconds since the first."""
        t = F.unix_timestamp(F.col("ts").cast("timestamp"))
        return self.raw("events").select(
            F.col("user_id").alias("track_id"), F.col("event_id").alias("point_id"), t.alias("t"),
            (46 + (F.col("event_id") % 1000) / 10000.0).alias("lat"), (7 + F.round(F.col("value"), 4) / 10000.0).alias("lng"), F.round("value", 4).alias("value"),
        )


def visible() -> Column:
    """Sections that are neither disabled nor superseded."""
    return ~F.col("disabled") & F.col("superseded_by").isNull()


#: The same tables as CTEs in DuckDB SQL.
PRELUDE = """
with recursive metrics as (
  select o_orderkey activity_id, epoch(o_orderdate)::bigint date,
    case o_orderpriority when '1-URGENT' then 'Ride' when '2-HIGH' then 'Run' when '3-MEDIUM' then 'Swim' when '4-NOT SPECIFIED' then 'WeightTraining' else 'Hike' end sport_type,
    round(e / 10, 3) distance, (q * 60)::bigint moving_time, round(o_totalprice / 1000, 5) training_load, 100 + o_custkey % 80 avg_hr,
    case when o_custkey % 9 <> 0 then 200 + o_custkey % 100 end ftp, o_custkey route_id,
    case o_orderstatus when 'O' then 'reverse' when 'P' then 'backward' else 'same' end direction, 'Activity ' || o_orderkey::varchar as name
  from orders join (select l_orderkey, sum(l_extendedprice) e, sum(l_quantity) q from lineitem group by 1) x on o_orderkey = l_orderkey),
activities as (
  select activity_id, sport_type, case when activity_id % 11 <> 0 then date end start_date, name, distance distance_meters, moving_time duration_secs,
    46 + (activity_id % 997) / 1000.0::double min_lat, 46 + (activity_id % 997) / 1000.0::double + 0.05::double max_lat,
    7 + (route_id % 499) / 500.0::double min_lng, 7 + (route_id % 499) / 500.0::double + 0.05::double max_lng from metrics),
sections as (
  select p_partkey section_id, case when p_partkey % 5 = 0 then 'custom' else 'auto' end section_type,
    case when p_partkey % 7 <> 0 then s || ' Section ' || p_partkey::varchar end as name, s sport_type, p_size * 100.0::double section_meters, p_partkey % 17 = 0 disabled,
    case when p_partkey % 23 = 0 then p_partkey - 1 end superseded_by, 46 + (p_partkey * 37 % 1000) / 2000.0::double lat, 7 + (p_partkey * 91 % 1000) / 2000.0::double lng
  from (select *, case p_size % 3 when 0 then 'Ride' when 1 then 'Run' else 'Hike' end s from part)),
section_points as (
  select section_id, point, lat + case when section_id % 2 = 0 then point * 100 / 111194.9::double else 0 end lat, lng + case when section_id % 2 = 0 then 0 else point * 100 / 111194.9::double end lng
  from (select section_id, lat, lng, unnest(range(0, (section_meters / 100)::bigint + 1))::int point from sections)),
traversals as (
  select section_id, activity_id, start_index, direction, distance_meters, lap_time, round(distance_meters / lap_time, 6) lap_pace, avg_hr, excluded from (
    select l_partkey section_id, l_orderkey activity_id, l_linenumber start_index, case max(l_returnflag) when 'R' then 'reverse' when 'A' then 'partial' else 'same' end direction,
      max(l_quantity) * 100.0::double distance_meters, case when max(l_suppkey) % 7 <> 0 then round(max(l_extendedprice) / 10, 3) end lap_time,
      round(110 + 100 * max(l_discount), 2) avg_hr, max(l_tax) > 0.07 excluded
    from lineitem group by l_partkey, l_orderkey, l_linenumber)),
wellness as (
  select strftime(d, '%Y-%m-%d') date, round(c, 4) ctl, round(m / 5, 4) atl, case when day(d) % 4 <> 0 then round(h, 4) end hrv, round((50 + n % 13)::double, 1) resting_hr from (
    select ts::date d, avg(value) c, max(value) m, avg(case when event_type = 'purchase' then value end) h, count(*) n from events group by 1)),
exercise_sets as (
  select l_orderkey activity_id, l_linenumber set_order, (max(l_partkey) % 35)::int exercise_category, case when l_linenumber % 4 = 0 then 1 else 0 end set_type,
    case when max(l_quantity)::int % 5 <> 0 then max(l_quantity)::int end repetitions, round(max(l_discount) * 100, 2) weight_kg from lineitem group by 1, 2),
points as (
  select user_id track_id, event_id point_id, floor(epoch(ts))::bigint t, 46 + (event_id % 1000) / 10000.0::double lat, 7 + round(value, 4) / 10000.0::double lng, round(value, 4) as value from events)
"""
