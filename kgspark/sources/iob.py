"""Token-label files: CSV with a header, CoNLL-style lines, and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kgspark.functions.labels import label_id, normalize_iob_label
from kgspark.functions.text import split_words, strip
from kgspark.vocab import BLANK

CSV_COLUMNS = ["words", "sentence_id", "labels"]


def clean_tokens(tokens: DataFrame) -> DataFrame:
    """Strip words and labels, default the label to O, add its id. One row in, one row out."""
    label = normalize_iob_label(strip(F.coalesce("labels", F.lit("O"))))
    return tokens.withColumns(
        {
            "words": strip(F.coalesce("words", F.lit(""))),
            "sentence_id": F.coalesce(F.col("sentence_id").cast("int"), F.lit(0)),
            "labels": label,
            "label_id": label_id(label),
        }
    )


PLACE = ["file", "start", "row"]


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with file, start of their split in the file, and a number that grows inside a split."""
    return rows.withColumns({"file": F.col("_metadata.file_name"), "start": F.col("_metadata.file_block_start"), "row": F.monotonically_increasing_id()})


def numbered(rows: DataFrame, name: str = "pos") -> DataFrame:
    """Rows with their number in the file, from 0, however the file was split.

    A split's rows are counted, and the counts of the splits before it are added to the number inside the split:
    one short row per split is all that is compared across splits.
    """
    splits = rows.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("file", "start").orderBy("row")) - 1
    return rows.withColumn("inside", inside).join(splits, ["file", "start"]).withColumn(name, F.col("before") + F.col("inside")).drop("first", "before", "inside")


def read_iob_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with header ``words,sentence_id,labels[,pos]``, one row per token.

    Rows keep ``file`` and, where the file has no ``pos`` column, get the number of the row in the file,
    the same for any number of splits. ``multi_line`` allows line ends inside quotes; such a file is one split.
    """
    raw = _placed(spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path))
    rows = raw if "pos" in raw.columns else numbered(raw)
    return clean_tokens(rows.drop("start", "row"))


def sentences(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sentence with its words and label ids in order."""
    item = F.struct("pos", "words", "label_id")
    rows = F.array_sort(F.collect_list(item))
    return (
        tokens.groupBy(*keys).agg(rows.alias("t"))
        .select(*keys, F.col("t.words").alias("words"), F.col("t.label_id").alias("label_ids"))
    )


def read_iob_lines(spark: SparkSession, path: str) -> DataFrame:
    """CoNLL-style files to ``file, sentence_no, pos, words, labels, label_id``.

    Lines end in LF or CRLF. A line's sentence is the number of blank lines before it in the file: those of earlier
    splits, counted per split, and those before it in its own split. ``pos`` is its number in the file.
    """
    lines = _placed(spark.read.text(path)).withColumn("blank", F.size(split_words(F.col("value"))) == 0)
    splits = lines.groupBy("file", "start").agg(F.count_if("blank").alias("blanks"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("earlier", F.coalesce(F.sum("blanks").over(before), F.lit(0))).drop("blanks")
    inside = F.count_if("blank").over(Window.partitionBy("file", "start").orderBy("row"))
    counted = numbered(lines.withColumn("inside_blanks", inside)).join(splits, ["file", "start"])
    rows = counted.withColumn("sentence_no", F.col("earlier") + F.col("inside_blanks"))
    fields = split_words(F.col("value"))
    label = normalize_iob_label(F.element_at(fields, -1))
    return rows.filter(F.size(fields) >= 2).select(
        "file", "sentence_no", "pos", F.element_at(fields, 1).alias("words"), label.alias("labels"), label_id(label).alias("label_id"))


def parse_iob_lines(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """CoNLL-style text to ``keys, sentence_no, pos, words, labels, label_id``.

    Blank lines end a sentence; lines with fewer than two fields are ignored. The text is cut
    at blank lines first and at line ends second, so no running count over a file is needed.
    """
    gap = "\n(?:" + BLANK.replace(r"\t-\r", r"\t\x0b-\r") + "*\n)+"
    blocks = texts.select(*keys, F.posexplode(F.split(text, gap)).alias("sentence_no", "block"))
    lines = blocks.select(*keys, "sentence_no", F.posexplode(F.split("block", "\n")).alias("pos", "line"))
    fields = split_words(F.col("line"))
    label = normalize_iob_label(F.element_at(fields, -1))
    return lines.filter(F.size(fields) >= 2).select(
        *keys,
        "sentence_no",
        "pos",
        F.element_at(fields, 1).alias("words"),
        label.alias("labels"),
        label_id(label).alias("label_id"),
    )


def iob_csv_line(word: Column, sentence_id: Column, label: Column, double_quotes: bool = False) -> Column:
    """One CSV line; a word with a comma or quote is quoted, inner quotes stay as they are.

    ``double_quotes`` doubles inner quotes, which readers of CSV expect.
    """
    inner = F.replace(word, F.lit('"'), F.lit('""')) if double_quotes else word
    quoted = F.when(word.contains(",") | word.contains('"'), F.concat(F.lit('"'), inner, F.lit('"')))
    return F.concat_ws(",", F.coalesce(quoted, word), sentence_id.cast("string"), label)


def write_iob_csv(tokens: DataFrame, path: str) -> None:
    """Well-formed CSV with a header in each part file."""
    tokens.select(*CSV_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def iob_file_profile(lines: DataFrame) -> DataFrame:
    """Per file of ``(file, line_no, line)``: header check, data rows and sentences."""
    fields = F.split("line", ",")
    header = F.lower(F.col("line"))
    has_all = header.contains("words") & header.contains("sentence_id") & header.contains("labels")
    is_data = F.col("line_no") > 0
    last = F.max(F.when(is_data & (strip(F.col("line")) != ""), F.col("line_no")))
    return lines.groupBy("file").agg(
        F.coalesce(F.bool_or(F.when(F.col("line_no") == 0, has_all)), F.lit(False)).alias("header_ok"),
        F.coalesce(last, F.lit(0)).cast("bigint").alias("n_rows"),
        F.count_distinct(F.when(is_data, F.get(fields, F.lit(1)))).alias("n_sentences"),
    )
