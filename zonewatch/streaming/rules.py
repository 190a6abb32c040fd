"""Rules over events as runs are committed. Evaluation is stateless for each event, so it is the batch transform.

The stream is the log of runs, not the folders of events: an attempt's events are read when its row in
`runs` has come, so attempts that fail, break off or are never committed give no match, and nothing has to
be held back in state. Of several attempts at a run the one that counts is evaluated. Matches carry
their attempt; an attempt that is replaced later, or stale since an earlier run was repeated, drops out
when they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules
from ..sources.state import MATCHES, Store


def matches_to(store: Store, rule_list: list[rules.Rule], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the matches of each committed run. A batch that is repeated after a failure replaces its own folder."""
    def batch(commits: DataFrame, number: int) -> None:
        new = commits.where("status = 'SUCCESS'").select("run_id", "attempt").distinct()
        attempts = [tuple(r) for r in store.succeeded().join(F.broadcast(new), ["run_id", "attempt"], "left_semi").collect()]  # a row a run
        found = rules.evaluate(store.events_of(attempts), rule_list)
        named = store.spark.createDataFrame(attempts, "run_id long, attempt string")
        found.join(F.broadcast(named), "run_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return store.commits().writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def read_matches(store: Store, path: str) -> DataFrame:
    """The matches at `path` of the attempts that count."""
    rows = store.spark.read.schema(f"{MATCHES}, attempt string").parquet(path)
    return rows.join(F.broadcast(store.succeeded()), ["run_id", "attempt"], "left_semi").drop("attempt", "batch")
