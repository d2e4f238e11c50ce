"""Submitted values to stored files with what can be derived from their bytes: text, images, media and documents.

A value is dispatched by its kind; all rules are expressions over one table, so that any number of submissions is one
job. Bytes are read by their first few, never by their name alone. Text of DOCX files needs an archive to be opened,
which is the one step in Python; PDF text and pictures' pixels need codecs that aren't here."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How many bytes a submission of each kind may have, and how much text is kept of a document.
MOST_BYTES = {"image": 5 * 1024 * 1024, "video": 50 * 1024 * 1024, "audio": 50 * 1024 * 1024, "document": 20 * 1024 * 1024}
MOST_TEXT = 200_000
# Content types by ending.
CONTENT_TYPES = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "csv": "text/csv",
    "json": "application/json", "html": "text/html", "htm": "text/html", "rtf": "application/rtf", "png": "image/png", "jpg": "image/jpg", "gif": "image/gif", "webp": "image/webp",
    "mp4": "video/mp4", "webm": "video/webm", "ogv": "video/ogg", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "flac": "audio/flac", "m4a": "audio/mp4",
}
TEXT_ENDINGS = ("txt", "md", "markdown", "csv", "json", "html", "htm", "rtf")


def decoded(payload: Column) -> Column:
    """Bytes of base64, with or without a data: prefix; null if it is none."""
    return F.try_to_binary(F.regexp_replace(payload, "^data:[^,]*,", ""), F.lit("base64"))


def ending(content: Column, filename: Column, kind: Column) -> Column:
    """What the bytes are, as a file's ending that fits the kind; null if they are nothing that the kind takes."""
    head = F.hex(F.substring(content, 1, 12))
    riff = lambda what: head.startswith("52494646") & (F.substring(head, 17, 8) == what)
    brand = F.substring(head, 9, 8) == "66747970"
    image = F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("474946383"), "gif").when(riff("57454250"), "webp")
    video = F.when(brand, "mp4").when(head.startswith("1A45DFA3"), "webm").when(head.startswith("4F676753"), "ogv")
    audio = F.when(head.startswith("494433") | head.startswith("FFFB"), "mp3").when(riff("57415645"), "wav").when(head.startswith("4F676753"), "ogg").when(head.startswith("664C6143"), "flac").when(brand, "m4a")
    named = F.lower(F.regexp_extract(filename, r"\.([^./]*)$", 1))
    text = F.is_valid_utf8(content.cast("string"))
    document = (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), F.when(F.instr(content.cast("string"), "word/document.xml") > 0, "docx"))
        .when(text & named.isin(*TEXT_ENDINGS), named).when(text, "txt")
    )
    return F.when(kind == "image", image).when(kind == "video", video).when(kind == "audio", audio).when(kind == "document", document)


def picture_size(content: Column, end: Column) -> Column:
    """struct(width, height) from a picture's header, where it has one place; null otherwise."""
    number = lambda at, n, little=False: F.conv(F.hex(F.reverse(F.substring(content, at, n)) if little else F.substring(content, at, n)), 16, 10).cast("int")
    png = F.struct(number(17, 4).alias("width"), number(21, 4).alias("height"))
    low, high = (lambda at: F.conv(F.hex(F.substring(content, at, 1)), 16, 10).cast("int")), 256
    gif = F.struct((low(7) + low(8) * high).alias("width"), (low(9) + low(10) * high).alias("height"))
    return F.when(end == "png", png).when(end == "gif", gif)


def orientation(width: Column, height: Column) -> Column:
    ratio = width / F.nullif(height, F.lit(0))
    return F.when((width > 0) & (height > 0), F.when(ratio > 1.05, "landscape").when(ratio < 0.95, "portrait").otherwise("square"))


def alt_text(filename: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), "[_-]+", " ")


def _docx_text(data: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            xml = archive.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError, OSError):
        return ""
    return re.sub(r"<[^>]+>", "", xml.replace("</w:p>", "\n")).strip()


def ingest(values: DataFrame) -> DataFrame:
    """values(id, kind, payload, filename) -> (id, kind, stored, problem, ext, content_type, file_size, text, title, width,
    height, orientation, alt_text).

    Text values are stored as they are. The others are decoded and checked; stored is their name in user_uploads/, by
    content, so that equal files are one. What can't be taken has a problem and no name."""
    data, kind = F.col("data"), F.col("kind")
    limit = F.element_at(F.create_map(*(F.lit(v) for kv in MOST_BYTES.items() for v in kv)), kind)
    # The bytes are a lambda's variable, so that they are decoded once for all rules.
    known = F.get(F.transform(F.array(decoded(F.col("payload"))), lambda d: F.struct(d.alias("data"), ending(d, F.col("filename"), kind).alias("ext"))), F.lit(0))
    x = values.where("kind <> 'text'").withColumn("known", known).select("*", "known.*").drop("known")
    problem = F.when(data.isNull(), "not base64").when(F.octet_length(data) == 0, "empty").when(F.octet_length(data) > limit, "too large").when(F.col("ext").isNull(), "unsupported format")
    x = x.withColumn("problem", problem)
    docx = F.pandas_udf(lambda s: pd.Series([_docx_text(bytes(d)) if d is not None else None for d in s]), "string")
    opened = x.where((F.col("ext") == "docx") & F.col("problem").isNull()).withColumn("text", docx("data"))
    plain = x.where(~((F.col("ext") == "docx") & F.col("problem").isNull()) | F.col("ext").isNull())
    plain = plain.withColumn("text", F.when(F.col("problem").isNull() & F.col("ext").isin(*TEXT_ENDINGS), data.cast("string")).when(F.col("ext") == "pdf", ""))
    x = opened.unionByName(plain).withColumn("text", F.substring("text", 1, MOST_TEXT)).withColumn("size", picture_size(data, F.col("ext")))
    ok = F.col("problem").isNull()
    types = F.create_map(*(F.lit(v) for kv in CONTENT_TYPES.items() for v in kv))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(" \t\r"))), lambda s: F.length(s).between(2, 120))
    image = ok & (kind == "image")
    files = x.select(
        "id", "kind", F.when(ok, F.concat(F.lit("assets/user_uploads/"), F.substring(F.sha2("data", 256), 1, 32), F.lit("."), "ext")).alias("stored"), "problem", F.when(ok, F.col("ext")).alias("ext"),
        F.when(ok, F.try_element_at(types, F.col("ext"))).alias("content_type"), F.when(ok, F.octet_length(data)).alias("file_size"), F.when(ok, F.col("text")).alias("text"),
        F.when(ok & (kind == "document"), F.regexp_replace(F.get(lines, F.lit(0)), "^[# ]+", "")).alias("title"), F.when(image, F.col("size.width")).alias("width"), F.when(image, F.col("size.height")).alias("height"),
        F.when(image, orientation(F.col("size.width"), F.col("size.height"))).alias("orientation"), F.when(image, alt_text(F.col("filename"))).alias("alt_text"),
    )
    none = {c: F.lit(None).cast(t) for c, t in files.dtypes if c not in ("id", "kind", "stored")}
    return files.unionByName(values.where("kind = 'text'").select("id", "kind", F.col("payload").alias("stored"), *(c.alias(n) for n, c in none.items())).select(*files.columns))
