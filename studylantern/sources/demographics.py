"""Demographics export: read, match to learners, split PII from the rest."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studylantern.functions import moment, strip
from studylantern.operators.skew import join_facts
from studylantern.schemas import DEMOGRAPHIC_HEADERS, PII_HEADERS
from studylantern.sources.feeds import ORDINAL, line_ordinal, numbered_files

_BOM = "\ufeff"


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """number (of the file), first (of its file or not), record (text) and ordinal of the CSV records under ``path``.

    A line break within quotes does not end a record, so a file cannot simply be cut at line breaks. A line begins a record
    where an even number of quotes stands before it. The files are split like any text; a first pass counts the
    quotes of each split, sums over the splits of a file tell how each begins, and within a split a running count
    finds the records. Lines that a split begins with may belong to the last record of an earlier one. Nothing
    is larger than a split of one file, or a record.
    """
    raw = spark.read.text(path, lineSep="\n")
    line = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    rows = raw.select("value", F.input_file_name().alias("_file"), F.col("_metadata.file_block_start").alias("block"), line.alias("line"))
    rows = rows.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    splits = rows.groupBy("_file", "block").agg(F.sum("quotes").alias("quotes"))
    earlier = Window.partitionBy("_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("_file", "block", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("before"))

    here = Window.partitionBy("_file", "block").orderBy("line")
    inside = F.col("before") + F.coalesce(F.sum("quotes").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = rows.join(before, ["_file", "block"]).withColumn("begins", F.when(inside % 2 == 0, F.struct("block", "line")))
    placed = begun.withColumn("start", F.last("begins", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lasts = begun.groupBy("_file", "block").agg(F.max("begins").alias("newest"))
    carried = lasts.select("_file", "block", F.last("newest", ignorenulls=True).over(earlier).alias("carried"))
    whole = placed.join(carried, ["_file", "block"]).withColumn("start", F.coalesce("start", "carried"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"])
    records = whole.groupBy("_file", "start").agg(F.regexp_replace(F.array_join(texts, "\n"), "\r$", "").alias("record"))
    files = records.groupBy("_file").agg(F.min("start").alias("head"))
    numbered = records.join(files, "_file").join(numbered_files(raw), "_file")
    return numbered.select(
        F.col("_number").alias("number"), (F.col("start") == F.col("head")).alias("first"), "record",
        line_ordinal(F.col("_number"), F.col("start.block"), F.col("start.line")).cast("decimal(38,0)").alias(ORDINAL),
    )


def read_demographics(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, optional byte-order mark and quoted line breaks, all text. Empty and missing fields are empty strings.

    Columns follow the header of the first file; every file has one. A large file is read by as many tasks as it has splits.
    """
    records = csv_records(spark, path)
    heads = records.filter("first").orderBy("number").limit(1).collect()
    if not heads:
        return spark.createDataFrame([], f"Email string, {ORDINAL} decimal(38,0)")
    names = next(csv.reader([heads[0]["record"].lstrip(_BOM)], strict=True))
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    fields = F.from_csv("record", schema, {"escape": '"', "emptyValue": "", "nullValue": "\u0000", "maxCharsPerColumn": "-1", "multiLine": "true"})
    parsed = records.filter(~F.col("first") & (F.col("record") != "")).select(fields.alias("r"), ORDINAL)
    return parsed.select(*[F.coalesce(f"r.c{i}", F.lit("")).alias(n) for i, n in enumerate(names)], ORDINAL)


def match_demographics(rows: DataFrame, users: DataFrame, email: str = "Email") -> tuple[DataFrame, DataFrame]:
    """(matched rows with ``user_id``, skipped rows with ``skip_reason``).

    Addresses compare stripped and lower-cased. When several learners share
    one, the highest ``user_id`` is taken. Blank addresses are kept out of the
    join, so they do not pile up in one partition.
    """
    key = F.lower(strip(F.col(email)))
    keyed = rows.withColumn("match_key", F.coalesce(key, F.lit("")))
    owners = (
        users.select(F.lower(strip(F.col("email"))).alias("match_key"), "user_id")
        .filter(F.col("match_key") != "")
        .groupBy("match_key")
        .agg(F.max("user_id").alias("user_id"))
    )
    named = keyed.filter(F.col("match_key") != "")
    matched = join_facts(named, owners, ["match_key"]).drop("match_key")
    unknown = join_facts(named, owners, ["match_key"], "left_anti").withColumn("skip_reason", F.lit("no matching user"))
    blank = keyed.filter(F.col("match_key") == "").withColumn("skip_reason", F.lit("no email"))
    return matched, unknown.unionByName(blank).drop("match_key")


def split_pii(matched: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """(student_pii rows, student_demographics rows)."""
    have = set(matched.columns)
    extra = [ORDINAL] if ORDINAL in have else []

    def column(header: str, name: str):
        value = F.col(f"`{header}`") if header in have else F.lit(None).cast("string")
        if name in ("full_name", "email"):
            value = F.coalesce(strip(value), F.lit(""))
        return value.alias(name)

    def part(headers: dict[str, str]) -> DataFrame:
        cols = [column(h, n) for h, n in headers.items()]
        return matched.select("user_id", *cols, moment(as_of).alias("loaded_at"), *extra)

    return part(PII_HEADERS), part(DEMOGRAPHIC_HEADERS)
