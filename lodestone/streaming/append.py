"""Continuous indexing of files that are added: symbols of each new file are appended to a table.

The file source gives each file once; edits in place need the batch comparison in operators.incremental.
"""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.extract.csharp import extract_files
from lodestone.sources.tree import text_of


def stream_symbols(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.cs").option("recursiveFileLookup", True).load(root)
    rows = extract_files(files.select("path", text_of("content").alias("content")))
    symbols = rows.select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    return symbols.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
