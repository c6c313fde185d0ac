"""JSON sources and sinks, digests, output guards."""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import reduce
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from waymark.operators.digests import ordered_digest
from waymark.operators.staging import written_once
from waymark.sources.arrays import array_elements


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One object a line, blank lines skipped.

    Strict: a line that is no object, an array of objects among them, fails the
    read, which names file and line.  Lenient: such lines are rows of nulls.
    """
    if not strict:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    lines = spark.read.text(path).where(F.btrim("value") != "").select("value", F.col("_metadata.file_path").alias("path"))
    shown = F.concat(F.col("path"), F.lit(" is malformed, no object: "), F.left("value", F.lit(200)))
    line = F.when(F.startswith(F.ltrim("value"), F.lit("{")), F.col("value")).otherwise(F.raise_error(shown).cast("string"))
    return lines.select(F.from_json(line, schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, raw, keys``: lines as they are, and which keys are there at all.

    Tells a key that is absent from one that is null.
    """
    lines = spark.read.text(path).where(F.btrim("value") != "")
    return lines.select(F.input_file_name().alias("path"), F.col("value").alias("raw"), F.json_object_keys("value").alias("keys"))


def read_json_array(spark: SparkSession, path: str, schema: StructType | str, expected_sha256: str | None = None, expected_rows: int | None = None, id_col: str = "_id") -> DataFrame:
    """A file that is one JSON array of objects, checked: digest, row count, unique ids.

    The array is read in splits (``arrays``), so many tasks share a large one.
    """
    if expected_sha256 is not None:
        found = file_digests(spark, path).select("sha256").first()
        if found is None or found["sha256"] != expected_sha256:
            raise ValueError(f"{path}: digest differs")
    shown = F.concat(F.col("path"), F.lit(": no object: "), F.left("element", F.lit(200)))
    element = F.when(F.startswith(F.trim(F.translate("element", "\t\r\n", "   ")), F.lit("{")), F.col("element")).otherwise(F.raise_error(shown).cast("string"))
    rows = array_elements(spark, path).select(F.from_json(element, schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")
    if expected_rows is not None:
        n = rows.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("d"), F.count_if(F.col(id_col).isNull() | (F.btrim(id_col) == "")).alias("blank")).first()
        if n["n"] != expected_rows or n["d"] != expected_rows or n["blank"]:
            raise ValueError(f"{path}: {n['n']} rows, {n['d']} ids; {expected_rows} expected")
    return rows


def _loaded(content: bytes):
    """JSON text of a value in a form that Spark reads; nothing for blanks, an error for what does not parse."""
    text = bytes(content).decode("utf-8")
    return json.dumps(json.loads(text), ensure_ascii=False) if text.strip() else None


def scan_json_tree(spark: SparkSession, path: str) -> DataFrame:
    """``path, value`` (JSON text) of every ``.json`` and ``.jsonl`` under a folder.

    A line that does not parse or is not UTF-8 ends its file; a whole file of
    which that holds has no values.  Lines end at line feeds and carriage
    returns only, so a line separator inside a string is a part of it.  Files of
    lines are read in splits: each split ends at its first bad line, and splits
    behind the first such split of their file go.
    """
    reader = lambda kind, ending: spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{ending}").load(path)
    whole = reader("binaryFile", "json").select("path", F.lit(0).cast("long").alias("start"), "content")
    lines = reader("text", "jsonl").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("content"))
    shape = "path string, start long, value string"

    def run(batches):
        ended = set()
        for pdf in batches:
            out = []
            for name, start, content in zip(pdf["path"], pdf["start"], pdf["content"]):
                if (name, start) in ended:
                    continue
                try:
                    value = _loaded(content)
                    if value is not None:
                        out.append((name, start, value))
                except ValueError:  # bad bytes and bad JSON alike
                    ended.add((name, start))
                    out.append((name, start, None))
            yield pd.DataFrame(out, columns=["path", "start", "value"])

    parsed = written_once(lines.mapInPandas(run, shape))
    ends = parsed.where("value IS NULL").groupBy("path").agg(F.min("start").alias("end"))
    kept = parsed.join(ends, "path", "left").where("value IS NOT NULL AND (end IS NULL OR start <= end)")
    return kept.select("path", "value").unionByName(whole.mapInPandas(run, shape).where("value IS NOT NULL").select("path", "value"))


@udtf(returnType="value string")
class Harvest:
    """Table function: every string under a key, at any depth of a JSON text, in document order."""

    def eval(self, raw: str, key: str):
        if raw is None:
            return
        todo = [iter((json.loads(raw),))]
        while todo:  # a stack of its own: nesting is bounded by memory
            node = next(todo[-1], todo)
            if node is todo:
                todo.pop()
            elif isinstance(node, _Found):
                yield (node.text,)
            elif isinstance(node, dict):
                todo.append(iter([_Found(v) if k == key and isinstance(v, str) else v for k, v in node.items()]))
            elif isinstance(node, list):
                todo.append(iter(node))


class _Found:
    """A string that stood under the key."""

    def __init__(self, text: str):
        self.text = text


def harvest_key(values: DataFrame, key: str = "question") -> DataFrame:
    """``path`` and every string under a key at any depth of the JSON texts in ``value``.

    The table function is registered as ``harvest_strings`` for SQL as well.
    """
    values.sparkSession.udtf.register("harvest_strings", Harvest)
    found = values.select("path", "value").lateralJoin(Harvest(F.col("value").outer(), F.lit(key)).toDF(key))
    return found.select("path", key)


def keys_sorted(value: Column, kind: DataType) -> Column:
    """The value with the fields of its structs and the keys of its maps in order, at any depth."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*(keys_sorted(value.getField(f.name), f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: keys_sorted(v, kind.elementType))
    if isinstance(kind, MapType):
        ordered = F.array_sort(F.map_keys(value))
        return F.map_from_arrays(ordered, F.transform(ordered, lambda k: keys_sorted(F.element_at(value, k), kind.valueType)))
    return value


def _records(df: DataFrame) -> DataFrame:
    return df.select(*(keys_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, keys sorted at every depth; a path that exists is an error."""
    _records(df).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Add records to a run log; the committer makes them whole or absent."""
    _records(df).write.mode("append").option("ignoreNullFields", False).json(path)


def _write_text(path: str, text: str, spark: SparkSession | None) -> None:
    """A small text; with a session into any store that Spark writes to, else on this machine."""
    if spark is None:
        with open(path, "w", encoding="utf-8") as out:
            out.write(text)
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_report(report: dict, path: str, spark: SparkSession | None = None) -> None:
    """A small report, indented, keys sorted, overwriting."""
    _write_text(path, json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n", spark)


def write_markdown(report: dict, path: str, title: str, spark: SparkSession | None = None) -> None:
    """A report as headings and lists."""

    def lines(node, depth: int):
        for k in sorted(node):
            if isinstance(node[k], dict):
                yield f"\n{'#' * min(6, depth)} {k}\n"
                yield from lines(node[k], depth + 1)
            else:
                yield f"- {k}: {node[k]}"

    _write_text(path, "\n".join([f"# {title}", *lines(report, 2)]) + "\n", spark)


def guard_outputs(*paths: str) -> None:
    """Fail before any work if an output is there already."""
    there = [p for p in paths if os.path.exists(p)]
    if there:
        raise FileExistsError(", ".join(there))


def guard_stored(spark: SparkSession, *paths: str) -> None:
    """The same for paths of any store that Spark writes to."""
    conf, make = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    there = [p for p in paths if make(p).getFileSystem(conf).exists(make(p))]
    if there:
        raise FileExistsError(", ".join(there))


#: Bytes that a task reads of a file at a time.
READ_BYTES = 8 << 20


def _opened(path: str):
    """A file of any store that pyarrow knows, as a stream; Spark's paths are not quoted."""
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    store, name = pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_stream(name)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of the files under a path, of any size.

    Spark lists them, empty ones included; a task reads its files in pieces of
    ``READ_BYTES``.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()
    files = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(p)),) for p in listed], "path string")

    def run(batches):
        for pdf in batches:
            out = []
            for name in pdf["path"]:
                h, n = hashlib.sha256(), 0
                with _opened(name) as f:
                    while piece := f.read(READ_BYTES):
                        h.update(piece)
                        n += len(piece)
                out.append((name, n, h.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "bytes", "sha256"])

    return files.repartition("path").mapInPandas(run, "path string, bytes long, sha256 string")


def tree_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of the canonical JSON map of relative paths to digests.

    The pairs are sorted by Spark and run through the hash as a stream.
    """
    root = path.rstrip("/") + "/"
    rows = file_digests(spark, path).select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), "sha256")
    pairs = rows.select(F.concat(F.lit('"'), F.substr("path", F.lit(len(root) + 1)), F.lit('":"'), F.col("sha256"), F.lit('"')).alias("p"))
    found = ordered_digest(pairs, "p", ["p"], join=",", head="{", tail="}").first()
    return found["sha256"] if found else hashlib.sha256(b"{}").hexdigest()


def named_sources(arguments: list[str]) -> dict[str, str]:
    """``NAME=PATH`` arguments; empty and repeated names are errors."""
    out: dict[str, str] = {}
    for a in arguments:
        name, mark, path = a.partition("=")
        if not mark or not name or not path or name in out:
            raise ValueError(f"bad or repeated source: {a!r}")
        out[name] = path
    return out


def read_models(spark: SparkSession, sources: dict[str, str], schema: StructType | str) -> DataFrame:
    """Score files of several models as one long table with a ``model`` column."""
    return reduce(DataFrame.unionByName, (read_jsonl(spark, p, schema).withColumn("model", F.lit(n)) for n, p in sources.items()))
