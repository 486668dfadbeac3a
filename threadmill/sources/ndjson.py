"""Readers of newline-delimited JSON, compressed or not, that keep the raw line and count bad ones.

Deliberate differences from a reader that works on raw chunks: a last line
without a newline is kept, and one bad line never fails a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

DUMP_NAME = "^RC_|^RS_"
KINDS = {"RC": "COMMENT", "RS": "SUBMISSION"}


def file_kind(name: Column) -> Column:
    """COMMENT or SUBMISSION by the prefix of the file name; any other name raises."""
    out = F.when(F.startswith(name, F.lit("RS")), F.lit(KINDS["RS"])).when(F.startswith(name, F.lit("RC")), F.lit(KINDS["RC"]))
    return out.otherwise(F.raise_error(F.concat(F.lit("neither a comment nor a submission file: "), name)).cast("string"))


def read_lines(spark: SparkSession, path: str | list[str], name_pattern: str | None = None, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """value, file_name, file_path, file_block and seq of each line.

    ``name_pattern`` is searched for anywhere in the file name. ``seq`` rises
    in reading order; ties of last-wins rules are broken by it.
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("file_block"), F.monotonically_increasing_id().alias("seq"))
    return lines.where(F.col("file_name").rlike(name_pattern)) if name_pattern else lines


def parse_lines(lines: DataFrame, schema: StructType, strict: bool = False) -> DataFrame:
    """The lines' fields by an explicit schema, with ``raw`` and ``bad``. Blank lines go; with ``strict`` a bad line fails the query."""
    some = lines.where(F.trim("value") != "")
    full = StructType(schema.fields + StructType.fromDDL("_corrupt string").fields)
    options = {"columnNameOfCorruptRecord": "_corrupt", "mode": "FAILFAST" if strict else "PERMISSIVE"}
    parsed = some.withColumn("_r", F.from_json("value", schema if strict else full, options))
    bad = F.lit(False) if strict else F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    kept = [c for c in lines.columns if c != "value"]
    return parsed.select(*(F.col(f"_r.{n}").alias(n) for n in schema.names), F.col("value").alias("raw"), bad.alias("bad"), *kept)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType, strict: bool = True, **listing) -> DataFrame:
    """Records of JSON lines files: strict fails on a bad line, tolerant skips it."""
    parsed = parse_lines(read_lines(spark, path, **listing), schema, strict)
    return parsed.where(~F.col("bad")).select(*schema.names, "file_name", "file_block", "seq")


def read_tolerant_checkpoint(spark: SparkSession, path: str, schema: StructType, key: str = "submission_id") -> DataFrame:
    """Checkpoint lines that parse and have the key; a truncated last line is skipped."""
    return read_jsonl(spark, path, schema, strict=False).where(F.col(key).isNotNull())


def read_if_present(spark: SparkSession, path: str, schema: StructType, required: bool = False, strict: bool = True) -> DataFrame:
    """A missing required input raises; a missing optional one is an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        return read_jsonl(spark, path, schema, strict)
    if required:
        raise FileNotFoundError(path)
    return spark.createDataFrame([], StructType(schema.fields + StructType.fromDDL("file_name string, file_block bigint, seq bigint").fields))


def read_generated_files(spark: SparkSession, path: str, schema: StructType, folders: bool = False) -> DataFrame:
    """All {model}_{strategy}.jsonl of a folder; model and strategy come from the file name where a record lacks them. Later records of a key win.

    With ``folders`` these are folders of files, as Spark writes them.
    """
    if folders:
        lines = read_lines(spark, path, recursive=True).withColumn("file_name", F.element_at(F.split("file_path", "/"), -2))
        rows = parse_lines(lines.where(F.col("file_name").rlike(r"^.+_[^_]+\.jsonl$")), schema).where("NOT bad").select(*schema.names, "file_name", "file_block", "seq")
    else:
        rows = read_jsonl(spark, path, schema, strict=False, glob="*_*.jsonl")
    rows = rows.where("submission_id IS NOT NULL")
    pattern = r"^(.+)_([^_]+)\.jsonl$"
    named = rows.withColumn("model", F.coalesce("model", F.regexp_extract("file_name", pattern, 1))).withColumn("strategy", F.coalesce("strategy", F.regexp_extract("file_name", pattern, 2)))
    order = F.struct("file_name", "file_block", "seq")
    rest = [c for c in schema.names if c not in ("submission_id", "model", "strategy")]
    return named.groupBy("submission_id", "model", "strategy").agg(F.max_by(F.struct(*rest), order).alias("r")).select("submission_id", "model", "strategy", "r.*")


def read_shard(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The lines (raw, with kind, prefix and value_lc) of one shard of a written split: only its folders are listed and read."""
    rows = spark.read.option("basePath", path).schema("value string, kind string, prefix string, value_lc string").text(f"{path}/kind=*/prefix={prefix}")
    return rows.withColumnRenamed("value", "raw")


def largest_first(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """path, bytes and turn of the files below a folder, largest first, equal ones by name; a scan orders its splits by size itself, this is for schedulers outside.

    With ``folders`` these are folders of files, as Spark writes them.
    """
    hidden = F.col("path").rlike(r"/[._][^/]*$")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~hidden).select("path", F.col("length").alias("bytes"))
    if folders:
        files = files.groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("path")).agg(F.sum("bytes").alias("bytes"))
    return files.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("bytes"), "path")).cast("bigint"))  # a listing, as long as the number of files or folders


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A status file's file list as rows: input_path, output_path, complete, lines_processed, error_lines, lines_matched."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "files array<array<string>>")["files"]).alias("f"))
    names = ("input_path", "output_path", "complete", "lines_processed", "error_lines", "lines_matched")
    kinds = ("string", "string", "boolean", "bigint", "bigint", "bigint")
    return rows.select(*(F.get("f", F.lit(i)).try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))))


def head(records: DataFrame, n: int = 5) -> DataFrame:
    """The first n records in reading order."""
    return records.orderBy("file_name", "file_block", "seq").limit(n)


class LongWindowZst(DataSource):
    """Lines of .zst files with windows beyond those Spark's own codec reads: format("zst_lines").load(path or glob).

    One partition for each file, as a compressed frame cannot be split; files
    are streamed, never held, and lines leave in Arrow batches. A path with a
    scheme is opened by pyarrow's file systems, any other as a local one.
    """

    @classmethod
    def name(cls) -> str:
        return "zst_lines"

    def schema(self) -> str:
        return "value string, file_name string, line_number bigint"

    def reader(self, schema) -> DataSourceReader:
        return _ZstReader(self.options["path"])


CHUNK = 8 << 20  # bytes of text in one Arrow batch


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _ZstReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import fnmatch

        from pyarrow import fs

        system, path = _file_system(self.path)
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            found = [path]
        else:
            folder = path if info.type == fs.FileType.Directory else path.rpartition("/")[0] or "."
            every = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
            found = sorted(x.path for x in every if x.type == fs.FileType.File and (x.path.endswith(".zst") if folder == path else fnmatch.fnmatch(x.path, path)))
        return [InputPartition(f if f.startswith(scheme) else scheme + f) for f in found] or [InputPartition(None)]

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard

        if partition.value is None:
            return
        system, path = _file_system(partition.value)
        name, number = path.rpartition("/")[2], 0

        def batch(text):
            """The lines of a text, which ends with a line's end or is the last."""
            nonlocal number
            lines = pc.list_flatten(pc.split_pattern(pa.array([text], pa.large_binary()).cast(pa.large_string()), "\n"))
            lines = lines.slice(0, len(lines) - text.endswith(b"\n")).cast(pa.string())
            out = pa.RecordBatch.from_arrays([lines, pa.array([name] * len(lines), pa.string()), pa.array(range(number, number + len(lines)), pa.int64())], names=["value", "file_name", "line_number"])
            number += len(lines)
            return out

        with system.open_input_stream(path, compression=None) as f, zstandard.ZstdDecompressor(max_window_size=2**31).stream_reader(f, read_across_frames=True) as stream:
            rest: list[bytes] = []
            while part := stream.read(CHUNK):
                cut = part.rfind(b"\n") + 1
                if cut:
                    yield batch(b"".join([*rest, part[:cut]]))
                    rest = [part[cut:]]
                else:
                    rest.append(part)
            if last := b"".join(rest):
                yield batch(last)


def read_long_window(spark: SparkSession, path: str) -> DataFrame:
    """As read_lines, for archives with windows up to 2**31."""
    spark.dataSource.register(LongWindowZst)
    rows = spark.read.format("zst_lines").load(path)
    return rows.select("value", "file_name", F.lit(path).alias("file_path"), F.lit(0).cast("bigint").alias("file_block"), F.col("line_number").alias("seq"))
