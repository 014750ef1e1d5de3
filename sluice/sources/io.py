"""Reading and writing tables by file ending.

CSV types are whole number, real, boolean or text, told from all rows; blanks
and the usual null tokens are null; dates stay text. Parquet is the format for
large tables and promises no row order unless one is named with ``order_by``.
"""

from __future__ import annotations

import io
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans.frame import HIDDEN, Frame, from_rows
from sluice.plans.values import PipeError
from sluice.runtime import Files

#: Texts that stand for no value in a CSV file.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
)


def _infer(df: DataFrame) -> DataFrame:
    """Types of text columns by one aggregate over all rows."""
    checks = []
    for c in df.columns:
        v = F.col(f"`{c}`")
        checks += [
            F.count(v).alias(f"{c}\x00n"),
            F.coalesce(F.bool_and(v.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$")), F.lit(True)).alias(f"{c}\x00i"),
            F.coalesce(F.bool_and(v.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(inf|Inf|Infinity|infinity)\s*$")), F.lit(True)).alias(f"{c}\x00f"),
            F.coalesce(F.bool_and(v.isin("true", "false", "True", "False", "TRUE", "FALSE")), F.lit(True)).alias(f"{c}\x00b"),
        ]
    got = df.agg(*checks).first().asDict()
    out = []
    for c in df.columns:
        v = F.col(f"`{c}`")
        if not got[f"{c}\x00n"]:
            out.append(v.cast("double").alias(c))
        elif got[f"{c}\x00i"]:
            out.append(F.trim(v).cast("bigint").alias(c))
        elif got[f"{c}\x00f"]:
            out.append(F.trim(v).cast("double").alias(c))
        elif got[f"{c}\x00b"]:
            out.append(F.lower(v).cast("boolean").alias(c))
        else:
            out.append(v)
    return df.select(*out)


def load(spark: SparkSession, path: str, order_by: list[str] | None = None) -> Frame:
    """A table from a file or folder. A missing or broken file is an error of
    the pipe. Columns that would clash with hidden ones are refused."""
    end = os.path.splitext(path.rstrip("/"))[1].lower()
    try:
        if end == ".parquet":
            f = Frame(spark.read.parquet(path), ordered=False)
        elif end == ".json":
            return _json(spark, path)
        elif end in (".yaml", ".yml"):
            import yaml

            got = yaml.safe_load(Files(spark, path).read(path))
            return from_rows(spark, [_plain(x) for x in (got if isinstance(got, list) else [got])])
        elif end == ".txt":
            lines = Frame(spark.read.text(path).select(F.col("value").alias("line")).filter(F.trim("line") != ""))
            f = lines.indexed("index")
            return Frame(f.data.select("line", "index", *f.secret), f.order)
        else:
            # only a line break within quotes asks for one task a file: then some line has an odd number of quote marks
            odd = spark.read.text(path).filter(F.size(F.split("value", '"', -1)) % 2 == 0)
            raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=not odd.isEmpty(), quote='"', escape='"')
            for c in raw.columns:
                v = F.col(f"`{c}`")
                raw = raw.withColumn(c, F.when(v.isin(*NULL_TOKENS), None).otherwise(v))
            f = Frame(_infer(raw))
    except PipeError:
        raise
    except Exception as bad:
        raise PipeError(f"load {path}: {str(bad).splitlines()[0][:200]}") from bad
    if any(c.startswith(HIDDEN) for c in f.data.columns):
        raise PipeError(f"load: column names must not start with {HIDDEN}")
    if order_by:
        data, order = f.data, []
        for i, c in enumerate(order_by):
            data = data.withColumn(f"{HIDDEN}k{i}", F.col(f"`{c}`"))
            order.append((f"{HIDDEN}k{i}", True))
        f = Frame(data, tuple(order))
    return f


def _json(spark, path):
    df = spark.read.json(path, multiLine=not Files(spark, path).is_folder(path))  # a folder holds an object a line
    if df.columns == ["_corrupt_record"]:
        raise PipeError(f"load {path}: not JSON")
    casts = [F.col(f"`{f.name}`").cast(_wide(f.dataType)).alias(f.name) for f in df.schema.fields]
    return Frame(df.select(*casts))


def _wide(kind):
    return T.DoubleType() if isinstance(kind, T.DecimalType) else kind


def _plain(x):
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)


def save(f: Frame, path: str, single: bool | None = None) -> None:
    """Write the rows in order. CSV, TXT and Parquet are written by the
    executors: into a folder, or where ``single`` (default for local paths) into
    parts that are joined to one file, byte by byte. JSON and YAML documents are one
    value each, so their rows pass through the driver, a partition at a time."""
    end = os.path.splitext(path.rstrip("/"))[1].lower()
    df = f.visible()
    folder = os.path.dirname(path)
    local = "://" not in path
    if local and folder:
        os.makedirs(folder, exist_ok=True)
    if end == ".parquet":
        df.write.mode("overwrite").parquet(path)
        return
    if end in (".yaml", ".yml") or end == ".json" and local:
        _document(df, path, end)
        return
    if single is None:
        single = local
    if end == ".txt":
        text = df.select(F.col("line").cast("string")) if "line" in df.columns else df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
        text = text.select(F.coalesce(text.columns[0], F.lit("")).alias("value"))
        _parts(path, lambda to: text.write.text(to), None) if single else text.write.mode("overwrite").text(path)
        return
    if end == ".json":
        df.write.mode("overwrite").json(path)
        return
    flat = df.select(*[F.to_json(F.col(f"`{x.name}`")).alias(x.name) if isinstance(x.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{x.name}`") for x in df.schema.fields])
    plain = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if single:
        _parts(path, lambda to: flat.write.csv(to, **plain), flat.columns)
    else:
        flat.write.mode("overwrite").csv(path, header=True, **plain)


def _parts(path: str, write, header: list[str] | None) -> None:
    """One file from the parts that the executors write beside it."""
    import csv
    import glob
    import shutil
    import uuid

    folder = f"{path}.{uuid.uuid4().hex}"
    try:
        write("file://" + os.path.abspath(folder))
        with open(path, "wb") as out:
            if header is not None:
                line = io.StringIO()
                csv.writer(line, lineterminator="\n").writerow(header)
                out.write(line.getvalue().encode())
            for part in sorted(glob.glob(f"{folder}/part-*")):
                with open(part, "rb") as src:
                    shutil.copyfileobj(src, out)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


class _Text(io.StringIO):
    """A document for another file system, written when it is whole."""

    def __init__(self, spark, path):
        super().__init__()
        self.spark, self.path = spark, path

    def __exit__(self, *failed):
        if not any(failed):
            Files(self.spark, self.path).write(self.path, self.getvalue())
        return super().__exit__(*failed)


def _document(df: DataFrame, path: str, end: str) -> None:
    rows = (r.asDict(recursive=True) for r in df.toLocalIterator(prefetchPartitions=True))
    with open(path, "w") if "://" not in path else _Text(df.sparkSession, path) as out:
        if end == ".json":
            out.write("[")
            for i, r in enumerate(rows):
                body = json.dumps(r, indent=2, default=str, ensure_ascii=False).replace("\n", "\n  ")
                out.write(("," if i else "") + "\n  " + body)
            out.write("\n]\n")
        else:
            import yaml

            empty = True
            for r in rows:
                empty = False
                out.write(yaml.dump([_plain(r)], sort_keys=False, allow_unicode=True))
            if empty:
                out.write("[]\n")
