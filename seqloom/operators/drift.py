"""Schemas that drift between the files of a series.

Every line is loaded as a map from path to raw value; statistics of paths and types are summed
by file; neighbouring files of a series are compared; and all lines are projected to one typed
table with the casts that failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.runtime import cut, replicated, with_salt

FILE = ["dataset", "series_id", "file_no", "file_id"]
#: A rename holds if the values agree on at least this part of the records.
RENAME_SHARE = 0.8
#: Sub-keys over which the lines of one file are spread where a file's change list is joined to them.
FILE_SALTS = 32


def raw_kind(variant: Column, raw: Column) -> Column:
    """boolean, integer, decimal, text or null (JSON null) of one value; objects and arrays are text.

    The number's own text tells integers from decimals: a variant drops the zeros of "3.0". An
    object that names a field twice has no variant; its values are typed by their text.
    """
    s = F.schema_of_variant(variant)
    by_text = F.when(raw.isNull(), None).when(raw.isin("true", "false"), "boolean").when(raw.rlike(r"^-?\d+$"), "integer").when(raw.rlike(r"^-?\d+\.\d+$"), "decimal").otherwise("text")
    number = s.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return (
        F.when(variant.isNull(), by_text)
        .when(s == "VOID", None)
        .when(s == "BOOLEAN", "boolean")
        .when(number & raw.rlike(r"^-?\d+$"), "integer")
        .when(number, "decimal")
        .otherwise("text")
    )


def path_values(lines: DataFrame, payload: str = "payload", keep: list[str] = (), depth: int = 1) -> DataFrame:
    """One row per line and path: the columns of keep, then path, raw (text as written, without quotes), kind.

    A JSON null gives a row with null raw and kind; a payload that is null, no object, or not
    JSON gives none. depth: how many levels of objects are opened; paths of deeper ones are
    joined by dots, and an object at the last level is kept as JSON text. Written decimals keep
    their digits ("3.0" is not "3").
    """
    def opened(df: DataFrame, text: str) -> DataFrame:
        # "m" has each value's text as written, "v" its type.
        both = df.withColumn("_m", F.from_json(text, "map<string,string>")).withColumn("_v", F.try_parse_json(F.col(text)).cast("map<string,variant>"))
        return both.select(*[c for c in df.columns if c != text], F.explode("_m").alias("_k", "raw"), "_v").withColumn("_x", F.element_at("_v", F.col("_k"))).drop("_v")

    keep = list(keep)
    todo = opened(lines.where(F.trim(F.col(payload)).startswith("{")).select(*keep, F.col(payload).alias("_text")), "_text").withColumnRenamed("_k", "path")
    done = []
    for _ in range(depth - 1):
        deeper = todo.where(F.schema_of_variant("_x").startswith("OBJECT"))
        done.append(todo.where(~F.coalesce(F.schema_of_variant("_x").startswith("OBJECT"), F.lit(False))))
        todo = opened(deeper.select(*keep, F.col("path").alias("_up"), F.col("raw").alias("_text")), "_text").withColumn("path", F.concat_ws(".", "_up", "_k")).drop("_up", "_k")
    out = todo
    for d in done:
        out = out.unionByName(d.select(*todo.columns))
    kind = raw_kind(F.col("_x"), F.col("raw"))
    return out.select(*keep, "path", F.when(kind.isNotNull(), F.col("raw")).alias("raw"), kind.alias("kind"))


def file_types(values: DataFrame, by: list[str] = FILE) -> DataFrame:
    """Per file (the columns of by) and path: number of lines with it, of non-null values of each kind, and the resulting type.

    boolean if all values are; integer if all are; decimal if all are numbers and any has a
    decimal point; text otherwise; null if there is no non-null value.
    """
    n = lambda k: F.count_if(F.col("kind") == k)
    stats = values.groupBy(*by, "path").agg(
        F.count("*").alias("n_lines"), F.count("kind").alias("n_values"), n("boolean").alias("n_boolean"), n("integer").alias("n_integer"), n("decimal").alias("n_decimal"), n("text").alias("n_text")
    )
    v = F.col("n_values")
    kind = (
        F.when(v == 0, None).when(F.col("n_boolean") == v, "boolean").when(F.col("n_integer") == v, "integer").when(F.col("n_integer") + F.col("n_decimal") == v, "decimal").otherwise("text")
    )
    return stats.withColumn("type", kind)


def files_of(lines: DataFrame) -> DataFrame:
    """One row per file_id with the FILE columns; where lines of a file differ or are null, the smallest value. A null file_id is no file."""
    seen = lines.where("file_id is not null").select(*FILE).distinct()
    return seen.groupBy("file_id").agg(*[F.min(c).alias(c) for c in FILE if c != "file_id"]).select(*FILE)


def neighbours(lines: DataFrame) -> DataFrame:
    """Per file the one before it by file_no in its series: FILE columns, prev_id, prev_no (null for the first)."""
    by_no = Window.partitionBy("series_id").orderBy("file_no", "file_id")
    return files_of(lines).withColumn("prev_id", F.lag("file_id").over(by_no)).withColumn("prev_no", F.lag("file_no").over(by_no))


def changes(lines: DataFrame) -> DataFrame:
    """file_id, change_kind, old_field, new_field, old_type, new_type: each change and the file that brought it.

    lines: one row per line with dataset, series_id, file_no, file_id, line_no, record_key,
    payload. Names compare exactly. Repeated lines of a record count once (the first line).
    A rename is found by the values: over the records in both files where either field is
    non-null, the texts agree in at least four fifths. A field with no value in one of the two
    files has no type there and gives no type change. A series of one file, an empty table or
    lines without a readable payload give no change; lines without a file_id are of no file, and
    rows delivered twice change nothing.
    """
    types = cut(file_types(path_values(lines, keep=["file_id"]), ["file_id"]).select("file_id", "path", "type"))
    pairs = neighbours(lines).where("prev_id is not null").select("file_id", "prev_id")

    now = pairs.join(types, "file_id").select("file_id", "path", F.col("type").alias("new_type"), F.lit(True).alias("has_new"))
    old = pairs.join(types.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", "path", F.col("type").alias("old_type"), F.lit(True).alias("has_old"))
    both = now.join(old, ["file_id", "path"], "full_outer")

    gone, came = both.where("has_new is null"), both.where("has_old is null")
    moved = (
        gone.groupBy("file_id").agg(F.collect_list("path").alias("gone"))
        .join(came.groupBy("file_id").agg(F.collect_list("path").alias("came")), "file_id")
        .join(pairs, "file_id")
    )

    # The first line of each record, of files on either side of a possible rename, as one map.
    record = lines.where("record_key is not null").groupBy("file_id", "record_key").agg(F.min_by("payload", "line_no").alias("payload")).withColumn("m", F.from_json("payload", "map<string,string>")).drop("payload")
    record = with_salt(record, FILE_SALTS, "record_key")
    sides = replicated(moved, FILE_SALTS)
    new_side = record.join(sides, ["file_id", "_salt"]).select("file_id", "prev_id", "record_key", "gone", "came", F.col("m").alias("new_m"))
    old_side = record.join(sides.select(F.col("file_id").alias("of"), F.col("prev_id").alias("file_id"), "_salt"), ["file_id", "_salt"]).select(F.col("of").alias("file_id"), "record_key", F.col("m").alias("old_m"))
    votes = (
        new_side.join(old_side, ["file_id", "record_key"])
        .select("file_id", "old_m", "new_m", F.explode("gone").alias("old_field"), "came")
        .select("file_id", "old_field", F.explode("came").alias("new_field"), F.element_at("old_m", F.col("old_field")).alias("a"), F.element_at("new_m", F.col("new_field")).alias("b"), )
        .where("a is not null or b is not null")
        .groupBy("file_id", "old_field", "new_field")
        .agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
        .where(F.col("same") >= RENAME_SHARE * F.col("n"))
        .select("file_id", "old_field", "new_field")
    )
    renamed = cut(
        votes.join(gone.select("file_id", F.col("path").alias("old_field"), "old_type"), ["file_id", "old_field"]).join(came.select("file_id", F.col("path").alias("new_field"), "new_type"), ["file_id", "new_field"])
    ).select("file_id", "old_field", "new_field", "old_type", "new_type")

    nothing = F.lit("")
    added = came.join(renamed.select("file_id", F.col("new_field").alias("path")).distinct(), ["file_id", "path"], "left_anti").select("file_id", F.lit("added").alias("change_kind"), nothing.alias("old_field"), F.col("path").alias("new_field"), "old_type", "new_type")
    removed = gone.join(renamed.select("file_id", F.col("old_field").alias("path")).distinct(), ["file_id", "path"], "left_anti").select("file_id", F.lit("removed").alias("change_kind"), F.col("path").alias("old_field"), nothing.alias("new_field"), "old_type", "new_type")
    kept = both.where("has_old and has_new").select("file_id", F.col("path").alias("old_field"), F.col("path").alias("new_field"), "old_type", "new_type")
    retyped = kept.unionByName(renamed).where("old_type <> new_type")
    named = lambda df, kind: df.select("file_id", F.lit(kind).alias("change_kind"), "old_field", "new_field", "old_type", "new_type")
    return named(renamed, "renamed").unionByName(added).unionByName(removed).unionByName(named(retyped, "type_changed"))


def canonical_names(lines: DataFrame, found: DataFrame) -> DataFrame:
    """file_id, path, origin: the name under which the field first came up in its series.

    Renames are followed back file by file by pointer doubling over (position of the file in
    its series, name), so a chain of n renames takes log2(n) joins.
    """
    by_no = Window.partitionBy("series_id").orderBy("file_no", "file_id")
    files = files_of(lines).withColumn("pos", F.row_number().over(by_no)).select("series_id", "file_id", "pos")
    # An edge says: from this position on, new_field carries on what was old_field before it.
    edges = found.where("change_kind = 'renamed'").join(files, "file_id").groupBy("series_id", "pos", "new_field").agg(F.min("old_field").alias("old_field"))
    names = path_values(lines, keep=["file_id"]).select("file_id", "path").distinct().join(files, "file_id")
    # The edge in force for a field at a position is the last one at or before it.
    upto = Window.partitionBy("series_id", "name").orderBy("pos", "is_name").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def step(rows: DataFrame) -> DataFrame:
        marks = edges.select("series_id", F.col("new_field").alias("name"), "pos", F.struct(F.col("pos").alias("at"), "old_field").alias("edge"), F.lit(0).alias("is_name"), F.lit(None).cast("long").alias("file_id"), F.lit(None).cast("string").alias("path"))
        asked = rows.select("series_id", "name", "pos", F.lit(None).cast(marks.schema["edge"].dataType).alias("edge"), F.lit(1).alias("is_name"), "file_id", "path")
        held = marks.unionByName(asked).withColumn("edge", F.last("edge", ignorenulls=True).over(upto)).where("is_name = 1")
        return held.select("series_id", "file_id", "path", F.coalesce("edge.old_field", "name").alias("name"), F.when(F.col("edge").isNotNull(), F.col("edge.at") - 1).otherwise(F.col("pos")).alias("pos"), F.col("edge").isNotNull().alias("moved"))

    rows = cut(step(names.select("series_id", "file_id", "path", F.col("path").alias("name"), "pos")))
    while rows.where("moved").limit(1).count():
        rows = cut(step(rows.drop("moved")))
    return rows.select("file_id", "path", F.col("name").alias("origin"))


def consistent(lines: DataFrame, dataset: str, schema: dict[str, str], found: DataFrame) -> DataFrame:
    """One typed table of a dataset: file_id, line_no, record_key, the columns of schema, extras, failed_casts.

    schema: column -> Spark type, by the names the fields had in the first file. A value that
    does not cast gives null there and its raw text under the column's name in failed_casts; a
    field outside the schema goes to extras under the name it first had. Of several
    values of one origin in a line the first by name, then by text, holds the column; the others
    go to extras under their own names. Lines without a readable payload stay, with nulls; a row
    delivered twice is one line.
    """
    own = lines.where(F.col("dataset") == dataset)
    values = path_values(own, keep=["file_id", "line_no"]).join(canonical_names(own, found), ["file_id", "path"])
    entry = F.struct(F.concat_ws("\u0001", "origin", "path").alias("key"), F.col("raw").alias("value"))
    entries = values.where("raw is not null").groupBy("file_id", "line_no").agg(F.array_sort(F.collect_set(entry)).alias("e"))
    joined = own.groupBy("file_id", "line_no").agg(F.min("record_key").alias("record_key")).join(entries, ["file_id", "line_no"], "left")

    def raw(name: str) -> Column:
        return F.get(F.filter("e", lambda x: F.split(x["key"], "\u0001")[0] == name), F.lit(0))["value"]

    cols = {name: F.expr(f"try_cast(_raw_{i} as {kind})") for i, (name, kind) in enumerate(schema.items())}
    with_raw = joined.select("*", *[raw(name).alias(f"_raw_{i}") for i, name in enumerate(schema)])
    failed = F.filter(
        F.array(*[F.struct(F.lit(name).alias("key"), F.when(c.isNull() & F.col(f"_raw_{i}").isNotNull(), F.col(f"_raw_{i}")).alias("value")) for i, (name, c) in enumerate(cols.items())]),
        lambda x: x["value"].isNotNull(),
    )
    origin = lambda x: F.split(x["key"], "\u0001")[0]
    in_schema = lambda x: origin(x).isin(list(schema))
    beside = F.filter("e", lambda x, i: ~in_schema(x) | F.exists(F.slice("e", F.lit(1), i), lambda y: origin(y) == origin(x)))
    rest = F.transform(beside, lambda x: F.struct(F.when(in_schema(x), F.split(x["key"], "\u0001")[1]).otherwise(origin(x)).alias("key"), x["value"].alias("value")))
    return with_raw.select("file_id", "line_no", "record_key", *[c.alias(name) for name, c in cols.items()], F.to_json(rest).alias("extras"), F.to_json(failed).alias("failed_casts"))
