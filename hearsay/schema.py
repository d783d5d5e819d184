"""Canonical tables and the run store.

Every stage of the engine reads and writes these tables; ``conform`` gives a
DataFrame exactly a table's columns and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KIND = {"S": T.StringType(), "T": T.TimestampType(), "D": T.DoubleType(), "I": T.IntegerType(), "B": T.BooleanType(), "A": T.ArrayType(T.StringType())}

# Columns of the canonical tables, S string, T timestamp, D double,
# I int, B boolean, A array of strings.
_TABLES = {
    "events": "event_id:S ts:T channel:S author_raw:S author_alt:S text:S parent_id:S visible_until:T channel_family:S source_ref:S site:S source_kind:S ts_grade:S family:S",
    "lifecycle": "channel:S ts:T action:S actor:S event_id:S related_event_id:S revision_ref:S page_held:B round_id:S",
    "probes": "probe_id:S ts:T site:S actor:S ip16:S request_action:S param_family:S success_observed:B time_grade:S source_ref:S nearest_save_label:S nearest_save_dt_s:D n_labels_on_prefix:I cotimed_label:S",
    "reads": "agent_raw:S ts:T channel:S event_id:S method:S",
    "roster": "goal_id:S agent_id:S role:S goal:S detail:S start:T end:T created:T updated:T batch:S agent_name:S model:S",
    "directory": "agent_id:S name:S model:S vendor:S joined:T last_seen:T participating:B",
    "channels": "channel:S channel_id:S created:T deleted:T allow:A deny:A",
    "activity": "agent_id:S agent_name:S ts:T kind:S ref:S",
    "eras": "era_id:S label:S goal:S start:T end:T created:T updated:T",
    "summaries": "summary_id:S type:S target:S date:T day:I generated_by:S created:T updated:T latest:B n_events:I chars:I content:S",
    "digest": "event_id:S ts:T kind:S actor:S actor_id:S text:S summary_id:S day:I generated_by:S",
    "agents": "author_raw:S agent_strict:S agent_merged:S cohort:S n_events:I roster_agent:S",
    "claims": "claim_id:S event_id:S ts:T agent_strict:S agent_merged:S family:S episode:D item:S value_raw:S value_norm:S event_type:S latency_class:S latency_s:D timer_s:D wrong_flag:B correct_flag:B extractor:S",
    "tags": "event_id:S ts:T agent_strict:S agent_merged:S family:S is_answer:B is_arrival:B is_confirm:B is_prediction:B is_correction:B is_request:B is_independent:B techniques:A cites:A",
    "mentions": "event_id:S ts:T agent_strict:S agent_merged:S channel:S family:S item:S value_norm:S value_key:S visible_until:T",
    "exposures": "claim_id:S agent:S family:S episode:D item:S value_norm:S t_report:T t_public:T src_agent:S t_self_prepared:T gap_s:D D:I D_w10m:I D_w60m:I self_prepared:I D_cons:I D_cons_w60m:I y_instant:I latency_known:I y_consensus:D consensus_value:S latency_class:S wrong_flag:B t_public_visible:T D_visible:I src_deleted_before_report:I t_src_deleted:T item_fe:S",
    "edges": "src:S dst:S family:S item:S value_norm:S kind:S dt_s:D event_id:S within_clock_res:B",
    "chains": "family:S item:S value_key:S originator:S t0:T n_agents:I max_depth:I span_s:D",
    "roster_events": "event_id:S roster_agent:S role:S goal_id:S batch:S in_window:B era_id:S era:S",
}


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KIND[k]) for n, k in (c.split(":") for c in spec.split())])


TABLES: dict[str, T.StructType] = {name: _struct(spec) for name, spec in _TABLES.items()}
for _n in ("exposures", "edges", "chains"):
    TABLES[f"{_n}_merged"] = TABLES[f"{_n}_strict"] = TABLES[_n]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the table's columns: missing ones null, extra ones dropped."""
    have = set(df.columns)
    return df.select([(df[f"`{f.name}`"] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


class RunStore:
    """One Parquet dataset per table under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df = conform(df, name) if name in TABLES else df
        df.write.mode("overwrite").parquet(f"{self.path}/{name}.parquet")
        return self.read(name)

    def has(self, name: str) -> bool:
        fs, path = self._fs(f"{name}.parquet")
        return bool(fs.exists(path))

    def read(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(TABLES[name]) if name in TABLES else self.spark.read
        return reader.parquet(f"{self.path}/{name}.parquet")

    def write_text(self, name: str, text: str) -> None:
        fs, path = self._fs(name)
        out = fs.create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_text(self, name: str) -> str | None:
        fs, path = self._fs(name)
        if not fs.exists(path):
            return None
        return "\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.path}/{name}").collect())

    def clear(self) -> None:
        """Remove every stage's output before a new ingest."""
        fs, path = self._fs("")
        if fs.exists(path):
            for entry in fs.listStatus(path):
                if entry.getPath().getName().endswith((".parquet", ".json", ".md", ".graphml")):
                    fs.delete(entry.getPath(), True)
