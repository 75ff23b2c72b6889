"""Reading documents from files and strings, and writing them back."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quire.functions import decode as D
from quire.options import encoding as known_encoding


def read_files(spark: SparkSession, path: str, encoding: str = "auto", pattern: str | None = None) -> DataFrame:
    """path, text, encoding of each file below a path, a row a file; encodings are told apart by file."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path).select("path", "content")
    return files.select("path", D.decode(F.col("content"), known_encoding(encoding)).alias("d")).select("path", "d.*")


def read_texts(spark: SparkSession, path: str, encoding: str = "auto") -> DataFrame:
    return read_files(spark, path, encoding).select("path", "text")


def strict_utf8(files: DataFrame, content: str = "content") -> DataFrame:
    """files with text; a row that isn't UTF-8 stops the query."""
    return files.withColumn("text", F.when(F.assert_true(D.is_utf8(F.col(content)), F.lit("input is not UTF-8")).isNull(), F.col(content).cast("string")))


def from_strings(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """doc_id, ord, text of strings given by hand; one line feed at the end goes."""
    return spark.createDataFrame([(i, i, t.removesuffix("\n")) for i, t in enumerate(texts)], "doc_id long, ord int, text string")


def from_stdin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0, sys.stdin.read())], "doc_id long, ord int, text string")


def side_text(path: str, encoding: str = "auto") -> str:
    """A file that goes around the output; one that can't be read is said and left out."""
    try:
        with open(path, "rb") as f:
            return D.decode_bytes(f.read(), known_encoding(encoding))[0]
    except OSError:
        print(f"Can't find or read {path}", file=sys.stderr)
        return ""


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt",)) -> DataFrame:
    """name, is_dir, path, bytes of one folder: folders first, then files with one of the suffixes, each by name in any case.

    The store is asked itself, since readers leave out empty files and folders."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    found = [(s.getPath().getName(), s.isDirectory(), s.getPath().toString(), s.getLen()) for s in folder.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(folder)]
    rows = spark.createDataFrame(found, "name string, is_dir boolean, path string, bytes long")
    test = F.col("is_dir")
    for s in suffixes:
        test = test | F.endswith(F.lower("name"), F.lit(s))
    return rows.where(test).orderBy(F.desc("is_dir"), F.lower("name"), "name")


def worst_encoding(files: DataFrame, encoding: str = "encoding") -> DataFrame:
    """The encoding of a set of inputs that most needs saying: wide over single-byte over UTF-8."""
    rank = F.create_map(*[F.lit(x) for pair in D.RANKS.items() for x in pair])[F.col(encoding)]
    return files.agg(F.max_by(encoding, rank).alias("encoding"))


def split_errors(converted: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(what can be written, what was refused)."""
    return converted.where(F.col(error).isNull()), converted.where(F.col(error).isNotNull())


def write_html(converted: DataFrame, path: str, by: str | None = None) -> None:
    """Only documents without errors; whole files appear at once, by the writer's commit."""
    good, _ = split_errors(converted) if "error" in converted.columns else (converted, None)
    writer = good.drop("error").write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_pages(pages: DataFrame, path: str, key: str = "doc_id") -> None:
    """Pages as tables in a folder of each document's, by name."""
    pages.repartition(F.col(key)).sortWithinPartitions(key, "page_no").write.mode("errorifexists").partitionBy(key).parquet(path)


def write_files(pages: DataFrame, path: str, name: str = "name", html: str = "html", sources: tuple[str, ...] = ()) -> DataFrame:
    """name, bytes, error: each row's HTML as a file of that name below path, in UTF-8.

    Files are written where their rows are, in any store that Arrow reaches, under a name of their own first, so a task that
    runs again leaves whole files. A name that leaves the folder or is one of the sources is refused and written nowhere."""
    from pyarrow import fs

    schema = StructType([StructField("name", StringType()), StructField("bytes", LongType()), StructField("error", StringType())])

    def put(store, base: str, own: str, content: bytes) -> None:
        full = f"{base}/{own}"
        if any(same_target(full, s) for s in sources):
            raise OSError(f"{own} is an input")
        store.create_dir(full.rpartition("/")[0], recursive=True)
        staged = f"{full.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        with store.open_output_stream(staged) as out:
            out.write(content)
        store.move(staged, full)

    def run(batches):
        store, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
        for batch in batches:
            rows = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content = (text or "").encode("utf-8", "replace")
                try:
                    if not own or own.startswith("/") or "\0" in own or ".." in own.split("/"):
                        raise OSError(f"{own!r} leaves the folder")
                    put(store, base.rstrip("/"), own, content)
                    rows.append((own, len(content), None))
                except OSError as why:
                    rows.append((own, None, str(why)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=[f.name for f in schema])

    return pages.select(name, html).mapInArrow(run, schema)


def same_target(path: str, source: str) -> bool:
    """Whether two local paths are one file, by whatever links."""
    try:
        return os.path.samefile(path, source)
    except OSError:
        return os.path.realpath(path) == os.path.realpath(source)


def save_html(html: str, path: str, source: str | None = None) -> None:
    """The HTML as a file, always in UTF-8, whole or not at all; never over the source it was made from."""
    if source is not None and same_target(path, source):
        raise OSError(f"{path} is the file that is converted; choose another name")
    staged = os.path.join(os.path.dirname(os.path.abspath(path)), f".{uuid.uuid4().hex}")
    try:
        with open(staged, "w", encoding="utf-8", newline="") as f:
            f.write(html)
        os.replace(staged, path)
    except OSError:
        if os.path.exists(staged):
            os.remove(staged)
        raise


def encoded(frame: DataFrame, encoding: str, text: str = "text") -> DataFrame:
    """frame with content (bytes) and error: the first character that the encoding lacks."""
    name = known_encoding(encoding)
    if name in ("auto", "utf-8"):
        return frame.withColumns({"content": F.encode(text, "UTF-8"), "error": F.lit(None).cast("string")})

    @F.pandas_udf("struct<content binary, error string>")
    def encode(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((D.encode_text(t or "", name), None))
            except D.EncodeError as why:
                rows.append((None, str(why)))
        return pd.DataFrame(rows, columns=["content", "error"])

    return frame.withColumn("e", encode(text)).select("*", "e.content", "e.error").drop("e")
