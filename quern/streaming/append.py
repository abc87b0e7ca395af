"""Each micro-batch becomes one segment and one commit.

The batch's number is the commit's payload, so a batch that runs again after a failure is recognised and skipped: with Spark's
checkpoint this makes appends exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.sources.snapshot import Writer


def append_stream(stream: DataFrame, writer: Writer, checkpoint: str, name: str = "append", **trigger: object) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        done = writer._manifest.payload
        if isinstance(done, dict) and done.get("stream") == name and done.get("batch", -1) >= number:
            return
        if batch.isEmpty():
            return
        writer.insert(batch)
        writer.commit({"stream": name, "batch": number})

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()
