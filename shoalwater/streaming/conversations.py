"""Growing conversations: bounded state by conversation, and verdicts that follow new messages.

Two forms.  ``windowed_state`` keeps the newest messages of a conversation as
keyed state (at most the limit, so state does not grow with history) and emits
its size after every micro-batch.  ``VerdictStream`` keeps messages in a table,
judges again only the conversations that a micro-batch touched, and writes each
batch's verdicts under its number, so that a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shoalwater.operators.document import Limits
from shoalwater.plans.detect import detect

_OUT = "req_id long, n_seen long, n_kept long, chars_kept long"
_STATE = "n_seen long, lengths array<long>"


def windowed_state(messages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(req_id, n_seen, n_kept, chars_kept) after each micro-batch of messages (req_id, msg_idx, text), in order of msg_idx within a batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, lengths = state.get if state.exists else (0, [])
        lengths = list(lengths)
        rows = pd.concat(list(batches)).sort_values("msg_idx")
        for text in rows["text"]:
            seen += 1
            lengths.append(len(text) if isinstance(text, str) else 0)
            lengths = lengths[-limits.max_messages :]
            while sum(lengths) > limits.max_chars and len(lengths) > 1:
                lengths.pop(0)
        state.update((seen, lengths))
        yield pd.DataFrame({"req_id": [key[0]], "n_seen": [seen], "n_kept": [len(lengths)], "chars_kept": [sum(lengths)]})

    return messages.groupBy("req_id").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


class VerdictStream:
    """Verdicts of conversations that grow; ``folder`` holds messages and verdicts by batch."""

    def __init__(self, folder: str, **detection):
        self.folder, self.detection = folder, detection

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of messages (req_id, msg_idx, sender, text)."""
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.folder}/messages/batch={batch_id}")
        history = spark.read.parquet(f"{self.folder}/messages").where(F.col("batch") <= batch_id).drop("batch")
        touched = spark.read.parquet(f"{self.folder}/messages/batch={batch_id}").select("req_id").distinct()
        found = detect(history.join(touched, "req_id", "left_semi"), **self.detection)
        found.verdicts.write.mode("overwrite").parquet(f"{self.folder}/verdicts/batch={batch_id}")

    def start(self, messages: DataFrame, checkpoint: str):
        """Run over a streaming source."""
        return messages.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).start()

    def latest(self, spark) -> DataFrame:
        """The newest verdict of each conversation."""
        newest = F.row_number().over(W.partitionBy("req_id").orderBy(F.desc("batch")))
        return spark.read.parquet(f"{self.folder}/verdicts").withColumn("rn", newest).where("rn = 1").drop("rn")


def next_unsaid(evidence, spoken):
    """The first evidence line that has not been said yet; null if none is left."""
    return F.get(F.array_except(evidence, F.coalesce(spoken, F.array().cast("array<string>"))), F.lit(0))
