"""Landed feed pages -> rows of the current-state tables.

Every ``*_from_feed`` is a pure projection/filter (plus one lookup join for
submissions and assignments). A feed frame may carry an ``ordinal`` column
giving the arrival order; it is passed through for the merge.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType

from studylantern.config import DEFAULT, Config
from studylantern.functions import bool_int, days_between, first_truthy, iso_timestamp, moment

ORDINAL = "ordinal"
RAW = "_unreadable"
#: Room that an ordinal leaves: records of a page, records within a wrapping record; of bulk files the line and its split.
_SLOTS, _INNER, _LINE_SLOTS, _LINES, _BLOCKS = 40, 40, 16, 30, 44


def _natural(path: str) -> str:
    """Text in which runs of digits sort by their number: page_2 before page_10."""
    return re.sub("[0-9]+", lambda digits: digits.group().zfill(20), path)


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _shifted(c: Column, bits: int) -> Column:
    return _whole(_whole(c) * F.lit(2**bits).cast("decimal(20,0)"))


def inner_ordinal(inner: Column) -> Column:
    """Place of a record within a wrapping record, to be added to the wrapper's ordinal."""
    return _whole(inner)


def line_ordinal(number: Column, block: Column, line: Column) -> Column:
    """Rank of a line by file number, split of the file and line of the task that reads the split, with room for what a line holds."""
    return _shifted(_shifted(_shifted(number, _BLOCKS) + block, _LINES) + line, 2 * _LINE_SLOTS)


def numbered_files(lines: DataFrame) -> DataFrame:
    """_file, _number of the files a frame reads, by name with numbers in it by value: the listing that the scan keeps on the driver."""
    files = sorted(lines.inputFiles(), key=lambda f: (_natural(f), f))
    return lines.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "_file string, _number long")


# --- fixed values: feeds whose pages may wrap their records in an object, and its field --
WRAPPERS = {"quiz_submissions": "quiz_submissions"}


def parse_pages(spark: SparkSession, path: str, schema: str, page_per_line: bool = False, wrapper: str | None = None) -> DataFrame:
    """One row for each record of the JSON pages under ``path``: a page is a list of records or one record.

    A page is first cut into the texts of its records, without a schema, and each text is parsed on its own: a malformed
    field costs its record, not the page. Columns: the schema's, null where the record cannot be read; ``page`` (file);
    ``ordinal``; and ``unreadable``, the text of a record that does not fit the schema, or of a page that
    cannot be cut, such as a truncated one. A folder's partition values fill the columns of their name. With ``wrapper`` a page
    may also be an object that holds its records in the list of that name.

    By default one file is one page; such files are small by nature and Spark packs many into a task. Bulk history is
    better landed with one page per line, which lets Spark split files of any size. The ordinal ranks pages by file name,
    with numbers in it by value, then by line, and records by their place in the page. It is one number, so a
    merge aggregates it in fixed-width buffers. File names are numbered from the listing that a scan keeps on the driver.
    """
    lines = spark.read.text(path, wholetext=not page_per_line)
    folders = [c for c in lines.columns if c != "value"]
    numbers = numbered_files(lines)
    # an empty file holds no page
    text = F.regexp_replace("value", "^[\\s\\x{FEFF}]+", "")
    pages = lines.select(
        *folders, text.alias("_page_text"), F.input_file_name().alias("_file"), F.col("_metadata.file_path").alias("_page"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("_line"),
    ).filter(F.col("_page_text") != "")
    first = F.substring("_page_text", 1, 1)
    single = F.array("_page_text")
    if wrapper is not None:
        single = F.coalesce(F.from_json(F.get_json_object("_page_text", f"$.{wrapper}"), "array<string>"), single)
    cut = F.when(first == "[", F.from_json("_page_text", "array<string>")).when(first == "{", single)
    fields = StructType.fromDDL(schema)
    # a page that cannot be cut goes on as one text, marked by its missing slot
    slots = F.posexplode_outer("_cut").alias("_slot", "_text")
    parsed = F.from_json("_text", f"{schema}, {RAW} string", {"columnNameOfCorruptRecord": RAW}).alias("_record")
    records = pages.withColumn("_cut", cut).join(numbers, "_file").select("*", slots).select("*", parsed)
    empty = F.col("_cut").isNotNull() & F.col("_slot").isNull()  # a list without records
    odd = F.col("_slot").isNull() | F.col("_record").isNull() | F.col(f"_record.{RAW}").isNotNull()
    slot = F.coalesce("_slot", F.lit(0))
    if page_per_line:
        room = F.when(slot < 2**_LINE_SLOTS, slot).otherwise(F.raise_error(F.lit("a line holds too many records")).cast("int"))
        place = line_ordinal(F.col("_number"), F.col("_block"), F.col("_line")) + _shifted(room, _LINE_SLOTS)
    else:
        place = _shifted(_shifted(F.col("_number"), _SLOTS) + slot, _INNER)

    def value(f) -> Column:
        if f.name in folders:
            return F.col(f.name).cast(f.dataType).alias(f.name)
        return F.when(~odd, F.col(f"_record.{f.name}")).alias(f.name)

    whole = F.when(F.col("_slot").isNull(), F.col("_page_text")).otherwise(F.coalesce("_text", F.lit("null")))
    partial = F.when(F.col("_slot").isNotNull() & F.col("_record").isNotNull(), F.to_json(F.struct(*[F.col(f"_record.{f.name}") for f in fields])))
    return records.filter(~empty).select(
        *[value(f) for f in fields], F.col("_page").alias("page"), _whole(place).alias(ORDINAL),
        F.when(odd, whole).alias("unreadable"), F.when(odd, partial).alias("parsed"),
    )


def records_of(parsed: DataFrame) -> DataFrame:
    """The readable records of ``parse_pages``, with their ordinal."""
    return parsed.filter(F.col("unreadable").isNull()).drop("page", "unreadable", "parsed")


def rejects_of(parsed: DataFrame) -> DataFrame:
    """page, record (its text) and parsed (what fitted the schema) of what could not be read."""
    return parsed.filter(F.col("unreadable").isNotNull()).select("page", F.col("unreadable").alias("record"), "parsed")


def read_pages(spark: SparkSession, path: str, schema: str, page_per_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of ``parse_pages``. Each reads the pages; who needs both stores the parsed frame."""
    parsed = parse_pages(spark, path, schema, page_per_line)
    return records_of(parsed), rejects_of(parsed)


def read_feed(spark: SparkSession, path: str, schema: str, page_per_line: bool = False) -> DataFrame:
    """The records of ``read_pages``."""
    return read_pages(spark, path, schema, page_per_line)[0]


def exclude_test_user(df: DataFrame, id_col: str, cfg: Config = DEFAULT) -> DataFrame:
    """Drop the platform's test learner; rows without an id stay."""
    return df.filter(F.col(id_col).isNull() | (F.col(id_col) != cfg.test_learner_id))


# --- fixed values: keys that a feed's records need before anything is derived --
REQUIRED_KEYS = {"submissions": ("assignment_id", "user_id"), "quiz_submissions": ("user_id",), "course_activity": ("date",)}


def _has_keys(df: DataFrame, cols: tuple[str, ...]) -> Column:
    keep: Column = F.lit(True)
    for name in cols:
        empty = "" if dict(df.dtypes)[name] == "string" else 0
        keep = keep & F.coalesce(F.col(name) != F.lit(empty), F.lit(False))
    return keep


def require_keys(df: DataFrame, *cols: str) -> DataFrame:
    """Drop rows with a missing, zero or empty key."""
    return df.filter(_has_keys(df, cols))


def without_keys(feed: DataFrame, name: str) -> DataFrame | None:
    """The records that a feed's projection drops for a missing, zero or empty key; None for feeds that drop none."""
    if name not in REQUIRED_KEYS:
        return None
    rows = quiz_records(feed) if name == "quiz_submissions" else feed
    return rows.filter(~_has_keys(rows, REQUIRED_KEYS[name]))


def _finish(df: DataFrame, *cols: Column) -> DataFrame:
    extra = [F.col(ORDINAL)] if ORDINAL in df.columns else []
    return df.select(*cols, *extra)


def users_from_feed(feed: DataFrame, as_of=None, cfg: Config = DEFAULT) -> DataFrame:
    return _finish(
        exclude_test_user(feed, "id", cfg),
        F.col("id").alias("user_id"),
        first_truthy(F.col("email"), F.col("sis_user_id"), F.col("login_id")).alias("email"),
        F.col("sis_user_id"),
        F.col("login_id"),
        moment(as_of).alias("updated_at"),
    )


def assignments_from_feed(feed: DataFrame, deadlines: DataFrame, as_of=None, cfg: Config = DEFAULT) -> DataFrame:
    """``deadlines``: the constant (assignment_id, due_at_roadmap) dimension."""
    planned = feed.join(
        deadlines.withColumnRenamed("assignment_id", "planned_id"), F.col("id") == F.col("planned_id"), "left"
    )
    return _finish(
        planned,
        F.col("id").alias("assignment_id"),
        F.lit(cfg.course_id).cast("long").alias("course_id"),
        F.col("name"),
        iso_timestamp(F.col("due_at")).alias("due_at"),
        F.col("points_possible"),
        F.col("due_at_roadmap"),
        moment(as_of).alias("updated_at"),
    )


def enrollments_from_feed(feed: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return _finish(
        feed,
        F.col("id").alias("enrollment_id"),
        F.lit(cfg.course_id).cast("long").alias("course_id"),
        F.col("user.id").alias("user_id"),
        F.col("type"),
        F.col("role"),
        F.col("enrollment_state"),
        iso_timestamp(F.col("last_activity_at")).alias("last_activity_at"),
        F.col("total_activity_time"),
        F.col("grades.current_score").alias("current_score"),
        F.col("grades.final_score").alias("final_score"),
        iso_timestamp(F.col("created_at")).alias("created_at"),
        iso_timestamp(F.col("updated_at")).alias("updated_at"),
    )


def summaries_from_feed(feed: DataFrame, as_of=None, cfg: Config = DEFAULT) -> DataFrame:
    late = F.col("tardiness_breakdown")
    return _finish(
        exclude_test_user(feed, "id", cfg),
        F.col("id").alias("user_id"),
        F.col("page_views"),
        F.col("max_page_views"),
        F.col("participations"),
        F.col("max_participations"),
        *[late[part].alias(f"tardiness_{part}") for part in ("on_time", "late", "missing", "floating", "total")],
        moment(as_of).alias("pulled_at"),
    )


def submissions_from_feed(feed: DataFrame, assignments: DataFrame, as_of=None, cfg: Config = DEFAULT) -> DataFrame:
    """Look up the planned deadline and derive the signed distance to it.

    The feed is the left side of a single join on ``assignment_id``: Spark
    broadcasts the assignments while they are small and splits a hot
    assignment's feed partition otherwise.
    """
    kept = require_keys(exclude_test_user(feed, "user_id", cfg), *REQUIRED_KEYS["submissions"])
    due = assignments.select("assignment_id", "due_at_roadmap")
    done = iso_timestamp(F.col("submitted_at"))
    return _finish(
        kept.join(due, "assignment_id", "left"),
        F.col("id").alias("submission_id"),
        F.col("assignment_id"),
        F.col("user_id"),
        F.col("score"),
        F.col("grade"),
        done.alias("submitted_at"),
        iso_timestamp(F.col("graded_at")).alias("graded_at"),
        F.col("workflow_state"),
        bool_int(F.col("late")).alias("late"),
        bool_int(F.col("missing")).alias("missing"),
        days_between(F.col("due_at_roadmap"), done).alias("days_from_deadline"),
        moment(as_of).alias("updated_at"),
    )


def quizzes_from_feed(feed: DataFrame, as_of=None, cfg: Config = DEFAULT) -> DataFrame:
    return _finish(
        feed,
        F.col("id").alias("quiz_id"),
        F.lit(cfg.course_id).cast("long").alias("course_id"),
        F.col("title"),
        F.col("quiz_type"),
        F.col("points_possible"),
        iso_timestamp(F.col("due_at")).alias("due_at"),
        bool_int(F.col("published")).alias("published"),
        F.col("question_count"),
        moment(as_of).alias("updated_at"),
    )


def quiz_records(feed: DataFrame) -> DataFrame:
    """Unwrap ``{quiz_submissions: [...]}`` pages or take bare records; ``quiz_id`` is the landing partition."""
    names = ("id", "user_id", "score", "kept_score", "attempt", "workflow_state", "started_at", "finished_at")
    bare = F.array(F.struct(*[F.col(n) for n in names]))
    records = F.coalesce(F.col("quiz_submissions"), bare)
    extra = []
    if ORDINAL not in feed.columns:
        feed = feed.select("quiz_id", F.explode(records).alias("rec"))
    else:
        whole = isinstance(feed.schema[ORDINAL].dataType, DecimalType)
        feed = feed.select("quiz_id", ORDINAL, F.posexplode(records).alias("slot", "rec"))
        inner = _whole(F.col(ORDINAL) + inner_ordinal(F.col("slot"))) if whole else F.struct(F.col(ORDINAL), F.col("slot"))
        extra = [inner.alias(ORDINAL)]
    return feed.select("quiz_id", *[F.col(f"rec.{n}").alias(n) for n in names], *extra)


def quiz_submissions_from_feed(feed: DataFrame, as_of=None, cfg: Config = DEFAULT) -> DataFrame:
    """One row for each attempt, from wrapped pages or bare records."""
    flat = quiz_records(feed)
    return _finish(
        exclude_test_user(require_keys(flat, *REQUIRED_KEYS["quiz_submissions"]), "user_id", cfg),
        F.col("id").alias("quiz_submission_id"),
        F.col("quiz_id"),
        F.col("user_id"),
        F.col("attempt"),
        F.col("score"),
        F.col("kept_score"),
        F.col("workflow_state"),
        iso_timestamp(F.col("started_at")).alias("started_at"),
        iso_timestamp(F.col("finished_at")).alias("finished_at"),
        moment(as_of).alias("updated_at"),
    )


def activity_from_feed(feed: DataFrame) -> DataFrame:
    """Views per day. A text that is no plain date gives a row without key, which the merge rejects."""
    return _finish(
        require_keys(feed, *REQUIRED_KEYS["course_activity"]),
        F.when(F.col("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("date").try_cast("date")).alias("activity_date"),
        F.col("views"),
        F.col("participations"),
    )
