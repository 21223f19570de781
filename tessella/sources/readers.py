"""Readers: every source becomes a DataFrame of a declared schema; nothing is inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

PAGE = "struct<page_number:int,text:string,ocr_confidence:double>"
#: All keys that chunk files may have; each may be missing.
CHUNK_SCHEMA = T.StructType([
    *[T.StructField(c, T.StringType()) for c in (
        "chunk_id", "doc_id", "official_title", "short_title", "title", "structure_path", "section_path", "article_number", "document_type",
        "language", "clean_text", "text", "legal_summary", "citation_label", "chunk_type", "publication_reference", "publication_date",
        "effective_date", "source_document_kind", "confidence")],
    *[T.StructField(c, T.ArrayType(T.StringType())) for c in (
        "topics", "topic_tags", "retrieval_keywords", "keywords", "entities", "user_questions", "citations", "cross_references", "obligations",
        "sanctions", "deadlines", "key_rules", "definitions")],
    T.StructField("manual_review_required", T.BooleanType()), T.StructField("page_start", T.IntegerType()), T.StructField("page_end", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df by key over as many partitions as there are cores, if it has fewer: a file of one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def json_collection(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array of objects; a missing path gives no rows, a broken file none either."""
    try:
        df = spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])).option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return df.where(F.col("_corrupt").isNull()).drop("_corrupt")


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """All chunk files of a folder, in order of name: an array of chunks, or an object with `chunks`.
    Document fields at the top level are not passed down; a broken file gives no rows."""
    wrapped = T.StructType([*CHUNK_SCHEMA.fields, T.StructField("chunks", T.ArrayType(CHUNK_SCHEMA)), T.StructField("_corrupt", T.StringType())])
    df = spark.read.schema(wrapped).option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
    df = df.where(F.col("_corrupt").isNull()).select("*", F.col("_metadata.file_name").alias("file_name"))
    own = F.struct(*[F.col(c) for c in CHUNK_SCHEMA.names])
    out = df.select("file_name", F.posexplode(F.coalesce("chunks", F.array(own))).alias("pos", "c"))
    return out.select("file_name", "pos", "c.*").where(F.coalesce("chunk_id", "clean_text", "text").isNotNull())


def chunk_index(spark: SparkSession, index_path: str, folder: str) -> DataFrame:
    """The prepared index if it is there, else the chunk files."""
    try:
        return spark.read.parquet(index_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return chunk_files(spark, folder)


def text_files(spark: SparkSession, paths: list[str], name_pattern: str = ".*") -> DataFrame:
    """file_name, text; of equal names the first folder wins."""
    from tessella.operators.relational import first_source

    parts = [spark.read.text(p, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")) for p in paths]
    return first_source([p.where(F.col("file_name").rlike(name_pattern)) for p in parts], "file_name")


def text_pages(files: DataFrame) -> DataFrame:
    """A text file is a document of one page."""
    page = F.struct(F.lit(1).alias("page_number"), F.col("text"), F.lit(None).cast("double").alias("ocr_confidence"))
    return files.select(F.col("file_name").alias("doc_id"), F.array(page).alias("pages"))


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page_number, text of PDF files; needs pypdf on the executors, a file it can't read gives no pages."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")

    def run(frames):
        import io

        import pandas as pd
        from pypdf import PdfReader  # an optional package

        for pdf in frames:
            rows = []
            for doc, body in zip(pdf["doc_id"], pdf["content"]):
                try:
                    rows += [(doc, n, page.extract_text() or "") for n, page in enumerate(PdfReader(io.BytesIO(body)).pages, 1)]
                except (ValueError, KeyError, OSError):
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "text"])

    return files.mapInPandas(run, "doc_id string, page_number int, text string")


def layout_pages(paragraphs: DataFrame, cells: DataFrame) -> DataFrame:
    """Pages of a layout service: paragraphs in order, then tables as rows of `a | b`.

    paragraphs: doc_id, page_number, pos, text; cells: doc_id, page_number, table_no, row_no, col_no, text.
    """
    text = paragraphs.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))
    text = text.select("doc_id", "page_number", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
    rows = cells.groupBy("doc_id", "page_number", "table_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "text"))).alias("c"))
    rows = rows.select("doc_id", "page_number", "table_no", "row_no", F.array_join(F.transform("c", lambda x: x["text"]), " | ").alias("line"))
    tables = rows.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("table_no", "row_no", "line"))).alias("r"))
    tables = tables.select("doc_id", "page_number", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("tables"))
    both = text.join(tables, ["doc_id", "page_number"], "full_outer")
    return both.select("doc_id", "page_number", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tables", F.lit("")).alias("tables"))


def manual_sections(docs: DataFrame) -> DataFrame:
    """A page for each section of a hand-written source (doc_id, sections array<struct<title, content>>)."""
    rows = docs.select("doc_id", F.posexplode("sections").alias("pos", "s"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("page_number"), F.concat_ws("\n", "s.title", "s.content").alias("text"))


def with_overrides(pages: DataFrame, overrides: DataFrame) -> DataFrame:
    """Pages whose text (and other told fields) an override replaces."""
    told = overrides.select("doc_id", "page_number", F.col("text").alias("_t"))
    return pages.join(told, ["doc_id", "page_number"], "left").withColumn("text", F.coalesce("_t", "text")).drop("_t")


def delimited_rows(spark: SparkSession, path: str) -> DataFrame:
    """row_number, cells, key of a text whose delimiter (; , or tab) is the most frequent in its first line.
    Cells are trimmed, empty lines skipped, quotes have no meaning, and a header line is not a row.
    The file is one unsplit text, so lines keep their order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")).alias("n", "value"))
    return parse_delimited(lines)


def parse_delimited(lines: DataFrame, header_words: tuple[str, ...] = ("product", "produit", "nom", "name", "designation", "dci", "reference")) -> DataFrame:
    """As delimited_rows, from n (order) and value."""
    from tessella.functions.text import normalise_text

    lines = lines.where(F.trim("value") != "")
    first = lines.orderBy("n").limit(1).select("value").collect()  # one line
    if not first:
        return lines.select(F.lit(1).alias("row_number"), F.array(F.lit("")).alias("cells"), F.lit("").alias("key")).where("false")
    delimiter = max((";", ",", "\t"), key=lambda d: (first[0][0].count(d), -";,\t".index(d)))
    rows = lines.select("n", F.transform(F.split("value", {";": ";", ",": ",", "\t": "\t"}[delimiter]), lambda v: F.trim(v)).alias("cells"))
    rows = rows.where(F.exists("cells", lambda c: c != ""))
    top = [c.strip() for c in first[0][0].split(delimiter)]
    has_header = spark_true(rows.sparkSession, top, header_words, normalise_text)
    if has_header:
        rows = rows.where(F.col("n") > F.lit(lines.agg(F.min("n")).first()[0]))
    key = F.try_element_at(F.filter("cells", lambda c: c != ""), F.lit(1))
    rows = rows.select("n", "cells", F.substring(F.regexp_replace(key, r"\s+", " "), 1, 240).alias("key"))
    g = rows.agg(F.array_sort(F.collect_list(F.struct("n", "cells", "key"))).alias("r"))  # one uploaded file
    return g.select(F.posexplode("r").alias("p", "r")).select((F.col("p") + 1).alias("row_number"), "r.cells", "r.key")


def spark_true(spark, cells, words, shape) -> bool:
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(shape(F.col("c")).alias("c"))
    return df.where(reduce(lambda a, b: a | b, [F.col("c").contains(w) for w in words])).limit(1).count() > 0


def spreadsheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, as delimited_rows; needs openpyxl on the driver (one uploaded file)."""
    from openpyxl import load_workbook  # an optional package

    sheet = load_workbook(path, read_only=True).worksheets[0]
    lines = [(i, "\t".join("" if v is None else str(v) for v in row)) for i, row in enumerate(sheet.iter_rows(values_only=True))]
    return parse_delimited(spark.createDataFrame(lines, "n int, value string"))


def aliased(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns under one name each, from the first of several aliases that is there and not blank."""
    out = []
    for name, aliases in names.items():
        have = [F.nullif(F.trim(F.col(a).cast("string")), F.lit("")) for a in aliases if a in df.columns]
        out.append((F.coalesce(*have) if have else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def translated(keys: DataFrame, words: dict[str, dict[str, str]], language: str, fallback: str = "fr") -> DataFrame:
    """key, text of dictionary keys: the language, else the fallback, else the key itself. A dictionary is small."""
    rows = [(lang, k, v) for lang, d in words.items() for k, v in d.items()]
    d = keys.sparkSession.createDataFrame(rows, "lang string, key string, text string")
    pick = lambda lang, c: F.broadcast(d.where(F.col("lang") == lang).select("key", F.col("text").alias(c)))
    out = keys.join(pick(language, "_a"), "key", "left").join(pick(fallback, "_b"), "key", "left")
    return out.select("key", F.coalesce("_a", "_b", "key").alias("text"))


def form_events(stream_or_table: DataFrame, body: str) -> DataFrame:
    """phone, message, normalised text and the open fields of posted forms."""
    from tessella.functions.text import form_values, normalise_text, phone_address

    f = form_values(F.col(body))
    return stream_or_table.withColumns({"phone": phone_address(f["From"]), "message": f["Body"], "text": normalise_text(f["Body"]), "fields": f})


def flatten_json(c, depth: int = 3):
    """Map path -> value of the scalars of a JSON text up to a depth; of equal last names the last stays.
    A nested {"value": x} counts as x under its own name."""
    none = F.create_map().cast("map<string,string>")
    level = F.from_json(c, "map<string,string>")
    out = none
    for _ in range(depth):
        level = F.coalesce(level, none)
        scalars = F.map_filter(level, lambda k, v: ~F.coalesce(v.startswith("{"), F.lit(False)))
        wrapped = F.map_filter(level, lambda k, v: F.coalesce(v.startswith("{"), F.lit(False)))
        out = F.map_concat(out, scalars, F.map_filter(F.transform_values(wrapped, lambda k, v: F.get_json_object(v, "$.value")), lambda k, v: v.isNotNull()))
        level = F.aggregate(F.map_values(wrapped), none, lambda a, v: F.map_concat(a, F.coalesce(F.from_json(v, "map<string,string>"), none)))
    return out
