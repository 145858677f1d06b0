"""Run by test_lost_tasks.py in its own process: retries need another master.

Every task dies once after it has handed on its last row, so the files that it was writing
are there and complete but for their end. Prints what came out as JSON.
"""

import json
import sys

import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.llm.minhash import near_duplicates
from millrace.llm.token_counts import document_token_counts
from millrace.llm.token_records import read_records, write_records
from millrace.llm.warc import derive, write_responses
from millrace.sources import read_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def dies_at_first(frame):
    def run(batches):
        yield from batches
        if TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost on purpose")

    return frame.repartition(3).mapInArrow(run, frame.schema)


spark = (
    SparkSession.builder.master("local[4,2]")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.sql.session.timeZone", "UTC")
    .getOrCreate()
)
spark.sparkContext.setLogLevel("WARN")  # so that the test sees the failures
sf_dir = sys.argv[1]
docs = dies_at_first(read_table(spark, sf_dir, "documents"))
pages = dies_at_first(read_table(spark, sf_dir, "pages"))
out = {
    "counts": document_token_counts(docs, PATH, 50256).select("doc_id", "n_tokens"),
    "records": read_records(dies_at_first(write_records(docs, PATH, 2))).select("doc_id", "start", F.size("ids").alias("n")),
    "warc": derive(write_responses(pages)).select("page_id", "text_digest"),
    "near": near_duplicates(docs).select("doc_id", "component_id"),
}
print(json.dumps({k: sorted(map(list, f.collect())) for k, f in out.items()}))
spark.stop()
