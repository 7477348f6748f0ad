"""The package on the executors' Python path."""

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import cartwright

_shipped: set[str] = set()


#: Rows that Spark hands to Python at once; texts are long, and the default of 10,000 is tens of MB.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> SparkSession:
    """Let Spark hand this package to all executors, once an application, and texts in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(cartwright.__file__))
        content = io.BytesIO()
        with zipfile.ZipFile(content, "w") as bundle:
            for folder, _, names in os.walk(root):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, os.path.dirname(root)))
        path = os.path.join(tempfile.mkdtemp(prefix="cartwright-"), "cartwright.zip")
        with open(path, "wb") as out:
            out.write(content.getvalue())
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark
