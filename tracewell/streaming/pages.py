"""Assessment of pages as they arrive. Each item is judged by itself, so no watermark and no state is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions import rules
from tracewell.operators import extract, report, risk

PAGES = "page_id long, url string, html string"


def assess_items(pages: DataFrame, capabilities=tuple(rules.CAPABILITIES)) -> DataFrame:
    """page_id, ord, kind, path, delivery, capability, level, kept of each item of pages' source; a batch or a stream."""
    none = F.lit(False)
    delivery = report.delivery(F.col("kind"), none, none, none)
    items = extract.items(pages).filter("key != ''").withColumns({"delivery": delivery, "visible": none}).drop("decoded", "invisible")
    found = risk.assess(risk.with_intents(risk.nfkc(items)), capabilities)
    return found.select("page_id", "ord", "kind", "path", "delivery", "capability", "level", "kept")


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, capabilities=tuple(rules.CAPABILITIES), once: bool = True) -> StreamingQuery:
    """Assesses the Parquet files that arrive in a folder and appends findings above `info` to out. once: what is there now, else on and on."""
    stream = spark.readStream.schema(PAGES).parquet(folder)
    found = assess_items(stream, capabilities).filter("level != 'info'")
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
