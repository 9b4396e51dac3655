"""Vertical and horizontal token text: reader, writer, and a Spark data source.

Vertical: `<doc id="..." lang="...">`, `<p>`, `<s>`, `<g/>`, and a row a token with tabs
between flags, form, lemma, pos, head, deprel. Horizontal: a sentence a line, tabs between
tokens and spaces between fields.
"""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schema import NO_SPACE, PARAGRAPH_START, SENTENCE_START, TEXT

_DOC, _ATTRIBUTE = re.compile(r"<doc\b([^>]*)>"), re.compile(r'(\w+)="([^"]*)"')
VISIBLE = 0x1F8


def _token(fields: list[str], starts: int) -> dict:
    cell = (fields + [""] * 6)[:6]
    flags = int(cell[0]) if cell[0].isdigit() else 0
    return {"flags": flags | starts, "form": cell[1], "lemma": cell[2] or None, "pos": cell[3] or None, "head": int(cell[4]) if cell[4].isdigit() else None, "deprel": cell[5] or None}


def parse_vertical(text: str) -> Iterator[dict]:
    doc, starts = None, 0
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if m := _DOC.match(line):
            if doc:
                yield doc
            a = {k: html.unescape(v) for k, v in _ATTRIBUTE.findall(m[1])}
            doc, starts = {"text_id": a.get("id", "unknown"), "language": a.get("lang", "").split(), "text": None, "tokens": []}, 0
        elif line in ("</doc>", "</p>", "</s>"):
            continue
        elif line == "<p>":
            starts |= PARAGRAPH_START | SENTENCE_START
        elif line in ("<s>", ""):
            starts |= SENTENCE_START
        elif doc is None:
            continue
        elif line == "<g/>":
            if doc["tokens"]:
                doc["tokens"][-1]["flags"] |= NO_SPACE
        else:
            doc["tokens"].append(_token(line.split("\t"), starts))
            starts = 0
    if doc:
        yield doc


def parse_horizontal(text: str, text_id: str = "unknown") -> Iterator[dict]:
    doc = {"text_id": text_id, "language": [], "text": None, "tokens": []}
    for line in text.split("\n"):
        if m := _DOC.match(line):
            if doc["tokens"]:
                yield doc
            a = dict(_ATTRIBUTE.findall(m[1]))
            doc = {"text_id": a.get("id", "unknown"), "language": a.get("lang", "").split(), "text": None, "tokens": []}
            continue
        for k, token in enumerate(x for x in line.split("\t") if x):
            doc["tokens"].append(_token(["0", *token.split(" ")], 0 if k else SENTENCE_START))
    if doc["tokens"]:
        yield doc


def rendered(emit_empty_lang: bool = False) -> Column:
    """A text row as vertical text, without its last newline."""
    lang = F.array_join("language", " ")
    head = F.concat(F.lit('<doc id="'), F.col("text_id"), F.lit('"'), F.when((lang != "") | F.lit(emit_empty_lang), F.concat(F.lit(' lang="'), lang, F.lit('"'))).otherwise(""), F.lit(">"))

    def line(t: Column) -> Column:
        has = lambda bit: t["flags"].bitwiseAND(F.lit(bit)) != 0
        fields = F.array(t["flags"].bitwiseAND(F.lit(VISIBLE)).cast("string"), t["form"], t["lemma"], t["pos"], t["head"].cast("string"), t["deprel"])
        last = F.greatest(*[F.when(F.get(fields, F.lit(k)).isNotNull(), k + 1).otherwise(0) for k in range(6)])
        row = F.array_join(F.transform(F.slice(fields, F.lit(1), last), lambda x: F.coalesce(x, F.lit(""))), "\t")
        return F.concat(F.when(has(PARAGRAPH_START), "<p>\n").otherwise(""), F.when(has(SENTENCE_START), "<s>\n").otherwise(""), row, F.when(has(NO_SPACE), "\n<g/>").otherwise(""))

    return F.concat_ws("\n", F.concat(F.array(head), F.transform("tokens", line), F.array(F.lit("</doc>"))))


def rendered_horizontal() -> Column:
    """A sentence a line; flags and missing spaces are lost."""

    def piece(t: Column) -> Column:
        start = t["flags"].bitwiseAND(F.lit(SENTENCE_START)) != 0
        paragraph = t["flags"].bitwiseAND(F.lit(PARAGRAPH_START)) != 0
        fields = F.concat_ws(" ", t["form"], t["lemma"], t["pos"], t["head"].cast("string"), t["deprel"])
        return F.concat(F.when(paragraph, "\n<p>").otherwise(""), F.when(start, "\n").otherwise("\t"), fields)

    return F.ltrim(F.array_join(F.transform("tokens", piece), ""))


def read(spark: SparkSession, path: str | list[str], horizontal: bool = False) -> DataFrame:
    """Texts of files; files are split at `<doc `, so that one large file feeds many tasks."""
    rows = spark.read.option("lineSep", "\n<doc ").text(path).select(F.when(F.startswith(F.col("value"), F.lit("<doc ")) | F.lit(horizontal), F.col("value")).otherwise(F.concat(F.lit("<doc "), F.col("value"))).alias("value"))
    parse = parse_horizontal if horizontal else parse_vertical

    @F.pandas_udf(T.ArrayType(TEXT))
    def run(column):
        import pandas as pd

        return pd.Series([list(parse(x)) for x in column], dtype=object)

    return rows.select(F.inline(run("value")))


def write(texts: DataFrame, path: str, horizontal: bool = False, emit_empty_lang: bool = False) -> None:
    texts.select((rendered_horizontal() if horizontal else rendered(emit_empty_lang)).alias("value")).write.mode("overwrite").text(path)


class VerticalSource(DataSource):
    """spark.read.format("vertical").load(file) and df.write.format("vertical")."""

    @classmethod
    def name(cls) -> str:
        return "vertical"

    def schema(self) -> T.StructType:
        return TEXT

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def _files(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, or of a URI such as file://, hdfs:// or s3://, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    """A task a file; a folder stands for its .vert files."""

    def __init__(self, options: dict) -> None:
        self.paths = options["path"].split(",")
        self.horizontal = options.get("horizontal", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            disk, root = _files(p)
            if disk.get_file_info(root).type == fs.FileType.Directory:
                scheme = p.split("://")[0] + "://" if "://" in p else ""
                found = disk.get_file_info(fs.FileSelector(root))
                out += sorted(scheme + x.path for x in found if x.is_file and x.extension == "vert")
            else:
                out.append(p)
        return [InputPartition(p) for p in out]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        disk, name = _files(partition.value)
        with disk.open_input_stream(name) as f:
            text = f.read().decode()
        for d in (parse_horizontal if self.horizontal else parse_vertical)(text):
            yield d["text_id"], d["language"], d["text"], [tuple(t.values()) for t in d["tokens"]]


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    """Tasks write under names of their own that readers don't see; the commit shows those of the tasks that count."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:
        disk, root = _files(self.path)
        disk.create_dir(root)
        name = f"{root}/_{self.job}-{uuid.uuid4().hex}.tmp"
        with disk.open_output_stream(name) as f:
            for r in rows:
                lang = " ".join(r["language"] or [])
                f.write((f'<doc id="{r["text_id"]}"' + (f' lang="{lang}"' if lang else "") + ">\n").encode())
                for t in r["tokens"] or []:
                    cells = [str(t["flags"] & VISIBLE), t["form"], t["lemma"], t["pos"], t["head"], t["deprel"]]
                    while cells and cells[-1] is None:
                        cells.pop()
                    marks = ("<p>\n" if t["flags"] & PARAGRAPH_START else "") + ("<s>\n" if t["flags"] & SENTENCE_START else "")
                    f.write((marks + "\t".join("" if c is None else str(c) for c in cells) + "\n" + ("<g/>\n" if t["flags"] & NO_SPACE else "")).encode())
                f.write(b"</doc>\n")
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        disk, root = _files(self.path)
        disk.create_dir(root)
        there = disk.get_file_info(fs.FileSelector(root))
        old = [x.path for x in there if x.is_file and x.extension == "vert"] if self.overwrite else []
        kept = [m.name for m in messages if m is not None]
        for k, name in enumerate(kept):
            disk.move(name, f"{root}/part-{k:05d}-{self.job}.vert")
        for name in old:
            disk.delete_file(name)
        self._clear(disk, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        disk, root = _files(self.path)
        if disk.get_file_info(root).type == fs.FileType.Directory:
            self._clear(disk, root)

    def _clear(self, disk: fs.FileSystem, root: str) -> None:
        """Files of attempts that don't count go."""
        for x in disk.get_file_info(fs.FileSelector(root)):
            if x.base_name.startswith(f"_{self.job}-"):
                disk.delete_file(x.path)
