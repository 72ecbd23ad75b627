"""Reading and writing the domain's files: transcripts, caption tracks, feeds, line logs, subtitles, scripts, pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = "text string, start double, end double, type string"
SKIPPED = ("script", "style", "nav", "footer", "head")


def transcripts(spark: SparkSession, path: str, types: tuple[str, ...] = ("word",)) -> DataFrame:
    """Words of transcript files, one JSON document each, a list of words or an object with that list under `words`: (file, pos, text, start, end, type)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    words = F.coalesce(F.from_json("value", f"struct<words: array<struct<{_fields(WORD)}>>>")["words"], F.from_json("value", f"array<struct<{_fields(WORD)}>>"))
    rows = raw.select("file", F.posexplode(words).alias("pos", "word")).select("file", "pos", "word.*")
    return rows.where(F.col("type").isin(*types))


def _fields(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.split() for x in schema.split(", ")))


def caption_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Caption files with nested events and segments: (file, start_s, word)."""
    schema = "struct<events: array<struct<tStartMs: bigint, segs: array<struct<utf8: string, tOffsetMs: bigint>>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema)["events"].alias("events"))
    events = raw.select("file", F.explode("events").alias("e")).select("file", "e.tStartMs", F.explode("e.segs").alias("s"))
    start = (F.col("tStartMs") + F.coalesce(F.col("s.tOffsetMs"), F.lit(0))) / 1000
    return events.select("file", start.alias("start_s"), F.explode(F.split(F.trim("s.utf8"), r"\s+")).alias("word")).where("word != ''")


def episodes(spark: SparkSession, path: str) -> DataFrame:
    """Items of feed files that have an enclosure, newest first, undated last: (title, date, url)."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, pubDate string, enclosure struct<_url: string>").load(path)
    date = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]+, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate"))
    return rows.where("enclosure._url is not null").select("title", date.alias("date"), F.col("enclosure._url").alias("url")).orderBy(F.desc_nulls_last("date"), "title")


def line_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log of JSON lines; lines that don't parse are skipped."""
    lines = spark.read.text(path).where(F.col("value").startswith("{"))
    return lines.select(F.from_json("value", f"struct<{_fields(schema)}>", {"mode": "PERMISSIVE"}).alias("row")).select("row.*").dropna("all")


def optional_json(spark: SparkSession, folder: str, names: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Documents that may be missing or broken, one file `name`.json each, anywhere below folder: (name, document), one row per row of names (name), and rejects (name, file, text).

    A file that isn't there or is empty, and one that isn't JSON of this schema, is a null document and no error; what couldn't be read is among the rejects."""
    corrupt = "_corrupt_record"
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.url_decode(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1)).alias("name"), "value")
    parsed = F.from_json("value", f"struct<{_fields(schema)}, {corrupt}: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    rows = raw.withColumn("parsed", parsed)
    broken = F.col("parsed").isNull() | F.col(f"parsed.{corrupt}").isNotNull()
    documents = rows.where(~broken).select("name", F.col("parsed").dropFields(corrupt).alias("document"))
    one = documents.groupBy("name").agg(F.first("document").alias("document"))
    return names.join(one, "name", "left"), rows.where(broken).select("name", "file", F.col("value").alias("text"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upserted(log: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """log with rows in place of its rows with the same key."""
    return log.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def first_of(sources: list[DataFrame], key: str) -> DataFrame:
    """All sources' rows; of rows with the same key those of the first source that has it."""
    every = None
    for k, df in enumerate(sources):
        df = df.withColumn("__source", F.lit(k))
        every = df if every is None else every.unionByName(df, allowMissingColumns=True)
    best = F.min("__source").over(W.partitionBy(key))
    return every.withColumn("__best", best).where("__source = __best").drop("__source", "__best")


def write_subtitles(cues: DataFrame, path: str) -> None:
    """Cues (one string each) as subtitle text, a blank line after each."""
    cues.select("cue").write.option("lineSep", "\n\n").text(path)


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """(nr, b, e, text), times in ms."""
    rows = spark.read.text(path, lineSep="\n\n").where(F.col("value").contains("-->"))
    part = lambda k: F.regexp_extract("value", r"(?s)^(\d+)\n(\S+) --> (\S+)\n(.*)$", k)
    return rows.select(part(1).cast("long").alias("nr"), cue_ms(part(2)).alias("b"), cue_ms(part(3)).alias("e"), part(4).alias("text"))


def cue_ms(time: Column) -> Column:
    x = F.split(F.translate(time, ",", ":"), ":")
    return ((x[0].cast("long") * 60 + x[1].cast("long")) * 60 + x[2].cast("long")) * 1000 + x[3].cast("long")


def script_lines(spark: SparkSession, path: str) -> DataFrame:
    """Spoken lines of scripts: no headings, rules or stage directions, no markup; (file, speaker, line)."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
    rows = rows.where(~F.col("line").rlike(r"^(#|---|===|\(|\[)") & (F.col("line") != "")).withColumn("line", F.regexp_replace("line", r"[*_`]", ""))
    speaker = F.regexp_extract("line", r"^([A-Z][A-Z ]{0,30}):\s", 1)
    return rows.select("file", F.when(speaker != "", speaker).alias("speaker"), F.regexp_replace("line", r"^[A-Z][A-Z ]{0,30}:\s+", "").alias("line"))


class _Lines(HTMLParser):
    """Text of a page by block, outside what is skipped."""

    BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote", "figcaption", "dt", "dd", "div", "br", "tr", "pre")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.tag, self.skipped = "body", 0

    def _end(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.lines.append((self.tag, text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self._end()
            self.skipped += 1
        elif tag in self.BLOCKS:
            self._end()
            self.tag = tag

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag in self.BLOCKS:
            self._end()
            self.tag = "body"

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)


def lines_of(html: str) -> list[tuple[str, str]]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end()
    return parser.lines


def _page_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html"), strict=True):
            seen: set[str] = set()
            for tag, text in lines_of(html.as_py() or ""):
                if 3 <= len(text) <= 260 and text not in seen:
                    seen.add(text)
                    rows.append((page, len(seen), tag, text))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["page_id", "nr", "tag", "line"])


def page_lines(pages: DataFrame) -> DataFrame:
    """Distinct lines of 3 to 260 characters of each page's text, without navigation and footer: (page_id, nr, tag, line)."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_page_lines, "page_id long, nr long, tag string, line string")
