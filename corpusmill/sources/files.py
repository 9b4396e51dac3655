"""Raw texts, URL lists, resource tables, generated rows, and wiki dumps."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls


def read_raw_text(spark: SparkSession, paths: str | list[str], list_in_file: bool = False) -> DataFrame:
    """One text a file: text_id (its name) and text. list_in_file: the files hold names of files; missing ones are skipped."""
    if list_in_file:
        paths = [r.value.strip() for r in spark.read.text(paths).filter("trim(value) <> ''").toLocalIterator()]
    rows = spark.read.option("wholetext", True).option("ignoreMissingFiles", True)
    hadoop = spark._jvm.org.apache.hadoop.fs
    known = [p for p in ([paths] if isinstance(paths, str) else paths) if (q := hadoop.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(q)]
    if not known:
        return spark.createDataFrame([], "text_id string, text string")
    return rows.text(known, wholetext=True).select(F.input_file_name().alias("text_id"), F.col("value").alias("text"))


def page_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """url of each line that isn't blank, with a scheme."""
    return lines.filter(F.trim(column) != "").select(urls.with_scheme(F.col(column)).alias("url"))


def generated_pages(spark: SparkSession, n: int, prefix: str = "", threads: int = 1) -> DataFrame:
    """n pages of test.org."""
    per = -(-n // threads)
    rows = spark.range(n)
    thread, i = F.floor(F.col("id") / per), F.col("id") % per
    return rows.select((thread * 10_000 + i).alias("page_id"), F.concat(F.lit(f"http://test.org/{prefix}"), thread.cast("string"), F.lit("-"), i.cast("string")).alias("url"))


def constant_index(spark: SparkSession, n: int = 100) -> DataFrame:
    return spark.range(n).select(F.lit(1).cast("long").alias("site_md5"), F.lit(2).cast("long").alias("path_md5"), F.lit(3).alias("modified"), F.lit(4).alias("size"), F.lit(5).alias("checksum"))


def constant_texts(spark: SparkSession, n: int = 100, text: str = "text") -> DataFrame:
    return spark.range(n).select(F.col("id").cast("string").alias("text_id"), F.lit(text).alias("text"))


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save(rows: DataFrame, path: str, most_rows: int = 0, compression: str = "zstd") -> None:
    rows.write.mode("overwrite").option("maxRecordsPerFile", most_rows).option("compression", compression).parquet(path)


def discard(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def dump(rows: DataFrame) -> DataFrame:
    """Each row as one line of JSON."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def _without(text: str, opening: str, closing: str) -> str:
    """text without balanced stretches between the two marks."""
    out, depth, at = [], 0, 0
    for m in re.finditer(f"{re.escape(opening)}|{re.escape(closing)}", text):
        if depth == 0:
            out.append(text[at : m.start()])
        depth = depth + 1 if m[0] == opening else max(0, depth - 1)
        at = m.end()
    return "".join(out) + ("" if depth else text[at:])


def plain_wiki(markup: str | None) -> str:
    """Paragraphs of MediaWiki markup."""
    text = re.sub(r"<!--.*?-->", "", markup or "", flags=re.DOTALL)
    text = _without(_without(text, "{{", "}}"), "{|", "|}")
    text = re.sub(r"(?is)<(ref|math|gallery|nowiki|pre|code)\b[^>/]*>.*?</\1\s*>", "", text)
    text = re.sub(r"<[^>]*>", "", text)
    text = re.sub(r"\[\[[^\[\]|:]+:[^\[\]]*\]\]", "", text)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", text)
    text = re.sub(r"\[\w+://\S+\s*([^\]]*)\]", r"\1", text).replace("'''", "").replace("''", "")
    lines = []
    for line in html.unescape(text).split("\n"):
        line = line.strip()
        if line and not re.match(r"[=|!]|#REDIRECT|----|__\w+__", line, re.IGNORECASE):
            lines.append(line.lstrip("*#:; "))
    return "\n\n".join(x for x in lines if x)


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """text_id (title) and text of a MediaWiki XML dump."""
    rows = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<text: string>").load(path)

    @F.pandas_udf("string")
    def plain(column: pd.Series) -> pd.Series:
        return column.map(plain_wiki)

    return rows.select(F.col("title").alias("text_id"), plain("revision.text").alias("text"))
