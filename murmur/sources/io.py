"""Readers and writers (#1-#7).

CSV follows the conventions of the files the reference reads: a header
row, RFC 4180 quoting (quoted newlines, doubled quotes) and pandas' NA
spellings turned into missing values. Parquet is the default sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.schemas import CATEGORIES_SCHEMA, CATEGORY_ID, NA_TOKENS


def na_to_null(df: DataFrame, na_tokens=NA_TOKENS) -> DataFrame:
    """String cells spelled like a missing value become NULL."""
    tokens = list(na_tokens)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(F.when(F.col(f.name).isin(tokens), F.lit(None).cast("string"))
                        .otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


#: How cells are read, by either reader.
CELLS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "mode": "FAILFAST"}


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, no, record): the records of quoted CSV files, every file read by as many tasks as it has blocks.

    Spark splits the files at line ends, whether quoted or not. A first pass
    counts each block's quotes; the parity of all quotes before a block (a
    running sum over one row per block) tells whether it begins inside a quoted
    cell. In the second pass each task joins its lines into records from that
    state on; the lines before the first record end of a block that begins
    inside a record, and those after its last one, are fragments, at most two a
    block, which are put together afterwards. ``block`` and ``no`` say where the
    record begins: the file's header is (0, 0). Empty lines between records are
    no records. A quote inside a cell is doubled and the cell quoted (RFC
    4180); a file whose quotes do not close fails.
    """
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    inside = (lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"))
              .select("file", "block", (F.coalesce(before, F.lit(0)) % 2).cast("int").alias("inside")))
    # A block that the first pass did not see (files or splits changed in between) has no parity: the task fails.
    held = lines.join(F.broadcast(inside), ["file", "block"], "left").select("file", "block", "inside", "value")

    def join_lines(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("no", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])
        place, state, waiting, no, ended = None, 0, [], 0, False

        def batch_of(rows, kinds):
            nonlocal no
            numbers = range(no, no + len(rows))
            no += len(rows)
            return pa.RecordBatch.from_arrays([pa.array([place[0]] * len(rows), pa.string()), pa.array([place[1]] * len(rows), pa.int64()),
                                               pa.array(numbers, pa.int64()), pa.array(kinds, pa.int32()), pa.array(rows, pa.string())], schema=schema)

        def rest():
            """What is left when a block ends inside a record: its beginning, or (kind 3) a stretch of one that neither begins nor ends here."""
            if waiting:
                yield batch_of(["\n".join(waiting)], [2 if ended or not began else 3])

        began = 0
        for batch in batches:
            files, blocks = batch.column(0), batch.column(1).to_numpy()
            codes = files.dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1]), True]) if len(blocks) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                now = (files[int(a)].as_py(), int(blocks[a]))
                if now != place:
                    if place is not None:
                        yield from rest()
                    if batch.column(2)[int(a)].as_py() is None:
                        raise ValueError(f"block {now} was not there when quotes were counted")
                    place, waiting, no, ended = now, [], 0, False
                    began = state = batch.column(2)[int(a)].as_py()
                value = batch.column(3).slice(int(a), int(b - a))
                odd = pc.count_substring(value, '"').to_numpy(zero_copy_only=False) & 1
                parity = (state + np.cumsum(odd)) & 1
                state = int(parity[-1])
                ends = np.flatnonzero(parity == 0)
                texts, rows, kinds, at = value.to_pylist(), [], [], 0
                for e in ends.tolist():
                    if waiting or e > at:
                        row = "\n".join([*waiting, *texts[at:e + 1]])
                        waiting = []
                    else:
                        row = texts[e]
                    kinds.append(1 if began and not ended else 0)
                    rows.append(row)
                    ended, at = True, e + 1
                waiting += texts[at:]
                if rows:
                    yield batch_of(rows, kinds)
        if place is not None:
            yield from rest()

    parts = held.mapInArrow(join_lines, "file string, block long, no long, kind int, record string")
    by_file = Window.partitionBy("file").orderBy("block", "no")  # two rows a block at most
    broken = parts.filter("kind > 0").withColumn("which", F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).over(by_file))
    begin = F.struct("block", "no", "kind", "record")
    mended = (broken.groupBy("file", "which").agg(F.sort_array(F.collect_list(begin)).alias("p"))
              .select("file", F.get("p", 0)["block"].alias("block"), F.get("p", 0)["no"].alias("no"),
                      F.when((F.get("p", 0)["kind"] == 2) & (F.element_at("p", -1)["kind"] == 1), F.array_join("p.record", "\n"))
                      .otherwise(F.raise_error(F.lit("quotes that do not close"))).alias("record")))
    whole = parts.filter("kind = 0").select("file", "block", "no", "record").unionByName(mended)
    return whole.withColumn("record", F.regexp_replace("record", r"\r\z", "")).filter("record <> ''")


def read_table_csv(spark: SparkSession, path: str, schema: T.StructType,
                   na_tokens=NA_TOKENS, multi_line: bool | None = None) -> DataFrame:
    """CSV with header, explicit schema, quoted newlines and doubled quotes.

    Every cell is read as text, NA spellings become NULL, then each column
    is cast to its schema type (a value that is neither NA nor a number
    fails, as ANSI casts do). Files of any size are split over many tasks,
    newlines inside quotes or not (see ``quoted_records``). ``multi_line=True``
    has Spark's own reader take each file in one task (for files that put bare
    quotes inside unquoted cells), ``multi_line=False`` has it split files
    that hold no newline inside quotes.
    """
    text_schema = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    if multi_line is None:
        options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CELLS.items()}
        records = quoted_records(spark, path).filter("block <> 0 or no <> 0")
        raw = records.select(F.from_csv("record", text_schema.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("r")).select("r.*")
    else:
        raw = spark.read.schema(text_schema).option("header", True).option("multiLine", multi_line).options(**CELLS).csv(path)
    clean = na_to_null(raw, na_tokens)
    return clean.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table; CSV gets a header and RFC 4180 quoting."""
    w = df.write.mode(mode)
    if fmt == "csv":
        (w.option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("emptyValue", '""').csv(path))
    elif fmt == "parquet":
        w.parquet(path)
    else:
        w.format(fmt).save(path)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Category JSON: each file holds ``{"items": [{id, snippet: {title}}]}``."""
    return (spark.read.schema(CATEGORIES_SCHEMA).option("multiLine", True).json(path)
            .withColumn("_file", F.input_file_name()))


def category_dim(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Flatten items to (categoryID, category); a repeated id keeps the last
    title. Ids are cast to int (strict: a bad id fails)."""
    items = raw.select("_file", F.posexplode("items").alias("pos", "item"))
    flat = items.select(
        F.col("item.id").alias("id"),
        F.col("item.snippet.title").alias("category"),
        F.struct(F.col("_file"), F.col("pos")).alias("_order"),
    )
    last = flat.groupBy("id").agg(F.max_by("category", "_order").alias("category"))
    cid = F.col("id").cast("int") if strict else F.expr("try_cast(id as int)")
    return last.select(cid.alias(CATEGORY_ID), "category")


def save_model(model, path: str) -> None:
    """Spark ML persistence of a whole fitted pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
