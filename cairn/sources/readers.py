"""Readers of stored tables and texts."""
from __future__ import annotations

import tomllib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions import proofs as P
from ..functions import text as T
from ..functions import vectors as V


def trajectories(spark: SparkSession, *paths: str, skip_corrupt: bool = False, file: str | None = None) -> DataFrame:
    """Rows of trajectory files, cast to the canonical types; ``file`` names a further column for the file each comes from.

    Unsigned ids are stored as such and arrive as decimals, so the scan reads natively and casts.
    Columns that old files lack are filled with their defaults; another missing column is an error.
    """
    reader = spark.read.option("mergeSchema", "true")
    if skip_corrupt:
        reader = reader.option("ignoreCorruptFiles", "true")
    raw = reader.parquet(*paths)
    columns = []
    for f in schemas.TRAJECTORY.fields:
        c = F.col(f.name) if f.name in raw.columns else F.lit(None)
        if f.name in schemas.OPTIONAL:
            c = F.coalesce(c, F.lit(schemas.OPTIONAL[f.name]))
        elif f.name not in raw.columns:
            raise ValueError(f"no column {f.name}")
        columns.append(c.cast(f.dataType).alias(f.name))
    if file:
        columns.append(F.input_file_name().alias(file))
    return raw.select(*columns).withColumn("label", F.when(F.col("label").isin("positive", "negative"), F.col("label")).otherwise("unknown"))


def theorem_names(traj: DataFrame) -> DataFrame:
    return traj.select("theorem_name").distinct()


def for_theorem(traj: DataFrame, name: str) -> DataFrame:
    return traj.filter(F.col("theorem_name") == name)


def with_file_order(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of several files with file_ord, the first place of their file in ``paths``: a scan for each schema, however many files."""
    kinds, places = {}, {}
    for p in dict.fromkeys(paths):
        found = spark.read.parquet(p)
        kinds.setdefault(found.schema.json(), []).append(p)
        for f in found.inputFiles():
            places.setdefault(f, paths.index(p))
    known = spark.createDataFrame([*places.items()], "file_ string, file_ord int")  # names of files, which the driver lists anyway
    rows = reduce(DataFrame.unionByName, [trajectories(spark, *ps, file="file_") for ps in kinds.values()])
    return rows.join(F.broadcast(known), "file_").drop("file_")


def theorem_index(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """pos, name, statement, file_path, line_number of an index document, the first ``first`` of it."""
    rows = spark.read.schema(schemas.THEOREM_INDEX).option("multiLine", True).json(path).select(F.posexplode("theorems").alias("pos", "t")).select("pos", "t.*")
    return rows if first is None else rows.filter(F.col("pos") < first)


def tactic_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs from JSON lines; blank lines are passed over, bad ones are an error.

    remaining_depth counts down to the deepest pair of the theorem.
    """
    rows = spark.read.schema(schemas.TACTIC_PAIRS).option("mode", "FAILFAST").json(path)
    return rows.withColumn("remaining_depth", F.max("depth").over(W.partitionBy("theorem")) - F.col("depth"))


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """An embedding cache; all vectors must have one length."""
    rows = spark.read.parquet(path).select(F.col("state_pp").cast("string"), F.col("embedding").cast("array<float>"))
    sizes = rows.select(F.size("embedding").alias("n")).distinct().limit(2).count()
    if sizes > 1:
        raise ValueError("embeddings differ in length")
    return rows


def usable_embeddings(rows: DataFrame, least: float = 1e-6) -> DataFrame:
    """Without vectors that have no length; of the rows of a state the last, in the order of files and rows."""
    rows = rows.withColumn("at", F.monotonically_increasing_id()).filter(V.norm(F.col("embedding")) >= least)
    return rows.groupBy("state_pp").agg(F.max_by("embedding", "at").alias("embedding"))


def whole_texts(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """path, text of whole files, the first ``first`` by path."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    if first is None:
        return rows
    names = rows.select("path").orderBy("path").limit(first)
    return rows.join(F.broadcast(names), "path", "left_semi")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(T.without_ansi(F.col("value")).alias("line"))


def skip_list(spark: SparkSession, path: str) -> DataFrame:
    """Names, one a line; blank lines and those from # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter(~F.col("name").startswith("#") & (F.col("name") != "")).distinct()


def evaluations(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(schemas.EVALUATION).option("multiLine", True).json(list(paths)).withColumn("path", F.input_file_name())


def compile_results(spark: SparkSession, path: str) -> DataFrame:
    """seq, status, module of a compile-result document."""
    return spark.read.schema(schemas.COMPILE_RESULTS).option("multiLine", True).json(path).select(F.explode("completed").alias("seq", "r")).select("seq", "r.*")


def proof_attempts(spark: SparkSession, path: str) -> DataFrame:
    """theorem, temperature, attempt, proof of a document theorem → temperature → proofs."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    by = doc.select(F.explode("m").alias("theorem", "t")).select("theorem", F.explode("t").alias("temperature", "p"))
    return by.select("theorem", "temperature", F.posexplode("p").alias("attempt", "proof"))


def config(defaults: dict, path: str | None = None, overrides: dict | None = None) -> dict:
    """Defaults, then the TOML file, then the overrides that aren't None."""
    out = dict(defaults)
    if path:
        with open(path, "rb") as f:
            for k, v in tomllib.load(f).items():
                out.update(v if isinstance(v, dict) else {k: v})
    return out | {k: v for k, v in (overrides or {}).items() if v is not None}


def traced_steps(spark: SparkSession, path: str) -> DataFrame:
    """A traced corpus: url, file_path, full_name, start, end, state_before, tactic."""
    return spark.read.parquet(path).select("url", "file_path", "full_name", "start", "end", "state_before", "tactic")


def training_texts(spark: SparkSession, path: str) -> DataFrame:
    """text, theorem, source, depth of JSON lines."""
    return spark.read.schema("text string, theorem string, source string, depth int").option("mode", "FAILFAST").json(path)


def benchmark_entries(spark: SparkSession, path: str) -> DataFrame:
    """split, name, statement of a list of entries (name, split, formal_statement); of equal names the first counts.

    Entries without a name or statement are left out; a missing split is ``valid``.
    """
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<name:string,split:string,formal_statement:string>>").alias("e"))
    rows = doc.select(F.posexplode("e").alias("pos", "e")).select("pos", *[T.strip(F.col(f"e.{c}")).alias(c) for c in ("name", "split", "formal_statement")]).filter("name <> '' AND formal_statement <> ''")
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("name").orderBy("pos"))).filter("n = 1")
    signature = F.regexp_replace(F.regexp_replace("formal_statement", r"(?s)^.*?theorem\s+\S+\s*", ""), r"(?s)\s*:=\s*(by)?(\s+sorry)?\s*$", "")
    return first.select(F.coalesce("split", F.lit("valid")).alias("split"), "name", P.expression_of(signature).alias("statement")).filter("statement <> ''")
