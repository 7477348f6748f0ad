"""Files of any store that Spark reaches, for marks and clean-up.

Spark has no public interface for these, so this class alone uses the session's JVM; it does not work
over Spark Connect. Tables themselves are read and written by Spark.
"""

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        hadoop_path = self._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self._conf), hadoop_path

    def write(self, path: str, text: str) -> None:
        """Write a small file; one that is there already is replaced."""
        fs, at = self._at(path)
        out = fs.create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def names(self, pattern: str) -> list[str]:
        """Last names of the paths that match, in order."""
        fs, at = self._at(pattern)
        return sorted(str(found.getPath().getName()) for found in fs.globStatus(at) or [])

    def changed(self, path: str) -> int:
        """Milliseconds of the last change."""
        fs, at = self._at(path)
        return fs.getFileStatus(at).getModificationTime()

    def changed_since(self, path: str, moment: float) -> bool:
        """Whether the path or any file below it changed after so many milliseconds.

        A folder's own time tells of its direct children only, not of what is written deeper down.
        """
        fs, at = self._at(path)
        try:
            if fs.getFileStatus(at).getModificationTime() > moment:
                return True
            below = fs.listFiles(at, True)
            while below.hasNext():
                if below.next().getModificationTime() > moment:
                    return True
        except Py4JJavaError:
            if fs.exists(at):
                return True  # files come and go: somebody is at work
        return False

    def size(self, path: str) -> tuple[int, int]:
        """Files and bytes below a path, without reading them."""
        fs, at = self._at(path)
        content = fs.getContentSummary(at)
        return content.getFileCount(), content.getLength()

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)
