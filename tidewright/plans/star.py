"""From raw feeds to the star schema: the composed builds that queries and views share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import align, cdc, dims, facts, identity, sensors, trips, vault
from ..session import shared_folder
from ..sources import feeds
from ..sources.bronze import envelope

#: Mean delivery radius in km of each kind of zone.
ZONE_RADIUS = {"DOWNTOWN": 3.0, "MIDTOWN": 2.8, "UPTOWN": 3.3, "SUBURBS-N": 5.0, "SUBURBS-S": 5.0}


def bronze(records: DataFrame) -> DataFrame:
    return envelope(records, F.col("ingested_at"))


def load_ts() -> Column:
    return F.lit("2002-01-01 00:00:00").cast("timestamp")


#: Paths of the tables written so far, by application, source files and table.
_WRITTEN: dict[tuple, tuple[str, StructType]] = {}
SOURCES = ("orders", "lineitem", "events", "part", "supplier", "nation")
LANDED = ("landed_orders", "landed_states", "landed_sensors", "landed_gps", "landed_menu")
#: Landed tables whose readers ask for days of ingestion.
BY_DAY = ("landed_orders",)
SILVER = ("silver_orders", "silver_states", "silver_readings", "silver_pings", "silver_menu")
#: What most views and checks read.
GOLD = ("gold_fact_order", "gold_customer")
#: Small dimensions that facts are joined with; written, they have a size that Spark knows and broadcasts.
SMALL = ("gold_kitchen", "gold_brand", "gold_zone")


class Star:
    """The star schema over one directory, layer by layer as in a lake.

    Raw records are landed once and parsed once into silver tables, and the order fact and the
    customer dimension are built once from those; all are Parquet in the shared folder, written
    when first asked for and read by every later query of the application while the source files
    are the same. Everything else is composed lazily.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return feeds.load(self.spark, self.dir, name)

    def _stamp(self) -> tuple:
        """Length, number and latest time of the source files, of those in a folder too, so that changed
        sources are landed anew."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        out = []
        for name in SOURCES:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}.parquet")
            fs = path.getFileSystem(conf)
            s = fs.getContentSummary(path)
            times = [f.getModificationTime() for f in fs.listStatus(path)]
            out += [s.getLength(), s.getFileCount(), max(times, default=0)]
        return tuple(out)

    def _key(self, name: str) -> tuple:
        return (self.spark.sparkContext.applicationId, self.dir, name, self._stamp())

    def stored(self, name: str) -> DataFrame:
        """The table ``name`` of LANDED, SILVER, GOLD or SMALL, written if it is not there yet."""
        key = self._key(name)
        if key not in _WRITTEN:
            path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
            df = getattr(self, f"_{name}")()
            if name in SMALL:
                df = df.coalesce(1)
            df.write.option("compression", "zstd").partitionBy(*(["ingestion_date"] if name in BY_DAY else [])).parquet(path)
            _WRITTEN[key] = (path, df.schema)
        path, schema = _WRITTEN[key]
        return self.spark.read.schema(schema).parquet(path).select(*schema.names)

    def stream_of(self, name: str) -> DataFrame:
        """A stream over the files of a stored table."""
        self.stored(name)
        path, schema = _WRITTEN[self._key(name)]
        return self.spark.readStream.schema(schema).parquet(path)

    def _landed_orders(self) -> DataFrame:
        records = feeds.order_records(self.spark, self.dir, by_day=True)
        return envelope(records, F.col("ingested_at"), day=F.col("ingestion_date"))

    def _landed_states(self) -> DataFrame:
        return bronze(feeds.status_records(self.spark, self.dir))

    def _landed_sensors(self) -> DataFrame:
        return bronze(feeds.sensor_records(self.spark, self.dir))

    def _landed_gps(self) -> DataFrame:
        return bronze(feeds.gps_records(self.spark, self.dir))

    def _landed_menu(self) -> DataFrame:
        return bronze(feeds.menu_records(self.spark, self.dir))

    def _silver_orders(self) -> DataFrame:
        return align.align(self.bronze_orders())

    def _silver_states(self) -> DataFrame:
        return align.status_events(self.bronze_orders().unionByName(self.stored("landed_states")))

    def _silver_readings(self) -> DataFrame:
        return sensors.clean(self.bronze_sensors())

    def _silver_pings(self) -> DataFrame:
        return trips.pings(self.bronze_gps())

    def _silver_menu(self) -> DataFrame:
        return cdc.menu_history(self.bronze_menu())

    def bronze_orders(self) -> DataFrame:
        return self.stored("landed_orders")

    def bronze_sensors(self) -> DataFrame:
        return self.stored("landed_sensors")

    def bronze_gps(self) -> DataFrame:
        return self.stored("landed_gps")

    def bronze_menu(self) -> DataFrame:
        return self.stored("landed_menu")

    def orders(self) -> DataFrame:
        return self.stored("silver_orders")

    def events(self) -> DataFrame:
        return self.stored("silver_states")

    def menu(self) -> DataFrame:
        return self.stored("silver_menu")

    def readings(self) -> DataFrame:
        return self.stored("silver_readings")

    def pings(self) -> DataFrame:
        return self.stored("silver_pings")

    def kitchen(self) -> DataFrame:
        return self.stored("gold_kitchen")

    def _gold_kitchen(self) -> DataFrame:
        return dims.from_seed(feeds.kitchens(self.spark, self.dir), "kitchen_id", "kitchen_key")

    def brand(self) -> DataFrame:
        return self.stored("gold_brand")

    def _gold_brand(self) -> DataFrame:
        return dims.from_seed(feeds.brands(self.spark, self.dir), "brand_id", "brand_key")

    def zone(self) -> DataFrame:
        return self.stored("gold_zone")

    def _gold_zone(self) -> DataFrame:
        return dims.zone(self.table("nation").select(F.col("n_name").alias("city")), ZONE_RADIUS)

    def date(self) -> DataFrame:
        return dims.date(self.spark, "1995-01-01", "2001-12-31")

    def hub(self) -> DataFrame:
        return vault.hub_customer(None, self.orders(), load_ts())

    def bridge(self) -> DataFrame:
        return identity.bridge(self.orders())

    def customer(self) -> DataFrame:
        return self.stored("gold_customer")

    def _gold_customer(self) -> DataFrame:
        return dims.customer(self.hub(), self.bridge(), self.orders())

    def fact_order(self) -> DataFrame:
        return self.stored("gold_fact_order")

    def _gold_fact_order(self) -> DataFrame:
        return facts.orders(self.orders(), self.kitchen(), self.brand(), self.zone(), facts.final_state(self.events()))

    def trips(self) -> DataFrame:
        return trips.link_orders(trips.summarise(self.pings()), self.fact_order())

    def gold(self) -> dict[str, DataFrame]:
        """The dimensional set, dimensions before facts."""
        return {
            "dim_date": self.date(), "dim_time": dims.time(self.spark), "dim_kitchen": self.kitchen(), "dim_brand": self.brand(), "dim_delivery_zone": self.zone(),
            "dim_menu_item": dims.menu_item(self.menu()), "dim_customer": self.customer(), "bridge_kitchen_brand": dims.pairs(self.orders(), self.kitchen(), self.brand()),
            "fact_order": self.fact_order(), "fact_order_state_history": facts.state_history(self.events(), self.kitchen()),
            "fact_sensor_hourly": sensors.fact_hourly(self.readings(), self.kitchen()), "fact_delivery_trip": self.trips(),
        }
