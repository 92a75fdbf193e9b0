"""Small text files on any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lattiq.errors import ContractError


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text; None if there is no such file."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text; False, and nothing done, if it is there already.  Of two callers one gets True."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":  # Hadoop's local files look first and create then
        try:
            with open(p.toUri().getPath(), "x", encoding="utf-8") as f:
                f.write(text)
            return True
        except FileExistsError:
            return False
    try:
        stream = fs.create(p, False)
    except Exception as error:
        if fs.exists(p):
            return False
        raise ContractError(f"{path} cannot be created") from error
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    return True


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of a folder's folders, in order."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def file_names(spark: SparkSession, path: str) -> list[str]:
    """The names of a folder's files, in order."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile()) if fs.exists(p) else []


def listing(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Length and time of change (ms) of all data files under a folder, by their path in it; names that start with _ or . are no data."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return {}
    base, out, found = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/", {}, fs.listFiles(p, True)
    while found.hasNext():
        s = found.next()
        name = s.getPath().toUri().getPath().removeprefix(base)
        if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
            out[name] = (s.getLen(), s.getModificationTime())
    return dict(sorted(out.items()))


def size_of(spark: SparkSession, path: str) -> int | None:
    """A file's length; None if there is no such file."""
    fs, p = _at(spark, path)
    return fs.getFileStatus(p).getLen() if fs.exists(p) and fs.getFileStatus(p).isFile() else None


def modified_at(spark: SparkSession, path: str) -> int:
    fs, p = _at(spark, path)
    return fs.getFileStatus(p).getModificationTime()


def sha256_of(spark: SparkSession, path: str) -> str:
    """A file's SHA-256, read as a stream by the driver's JVM."""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
