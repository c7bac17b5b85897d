"""Word files as a source: scan, hash, class and paragraphs.

Spark reads the bytes (``binaryFile``, any file system it knows); only the zip and XML of one file are read in Python.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import constants as K
from tessera.functions.text import basename, document_class, project_of_path
from tessera.operators.ingest import content_hash
from tessera.sources.tables import in_slices

FILE = "path string, modificationTime timestamp, length long, content binary"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_NO_XML = re.compile("[^\t\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
MAX_XML = 200 * 1024 * 1024


def scan(spark: SparkSession, root: str, pattern: str = "*.docx") -> DataFrame:
    """All files under ``root`` (``path, modificationTime, length, content``); a missing root is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], FILE)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def paragraphs(content: bytes | None) -> str:
    """Body paragraphs, trimmed, blank ones dropped, joined by line ends; tables are left out."""
    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
        if z.getinfo("word/document.xml").file_size > MAX_XML:
            raise ValueError("document too large")
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else ():
        text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
        if text.strip():
            out.append(text.strip())
    if not out:
        raise ValueError("document is empty")
    return "\n".join(out)


_TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


@F.arrow_udf(_TEXT)
def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Bytes -> (text, null) or (null, what went wrong, at most 200 characters): one bad file does not end the job."""
    for contents in in_slices(batches):
        out = []
        for content in contents.to_pylist():
            try:
                out.append({"text": paragraphs(content), "error": None})
            except Exception as e:  # noqa: BLE001  a file's fault is a value here
                out.append({"text": None, "error": f"{type(e).__name__}: {e}"[: K.ERROR_CHARS]})
        yield pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))


def described(files: DataFrame, root: str) -> DataFrame:
    """``doc_id`` (path below the root), ``project_name``, ``doc_type``, ``file_size_bytes``, ``hash`` and ``content`` of files."""
    full = F.regexp_replace("path", "^[a-z]+:/*", "/")
    below = F.when(F.contains(full, F.lit(root.rstrip("/") + "/")), F.element_at(F.split(full, F.lit(f"\\Q{root.rstrip('/')}/\\E")), -1)).otherwise(full)
    return files.select(
        below.alias("doc_id"), project_of_path(below).alias("project_name"), document_class(basename(below)).alias("doc_type"),
        F.col("length").alias("file_size_bytes"), content_hash(F.col("content")).alias("hash"), "content", "modificationTime",
    )


def expired(files: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Snapshots older than ``days``."""
    return files.where(F.col("modificationTime") < now - F.make_dt_interval(F.lit(days)))


def chapters(docs: DataFrame, text: str = "text") -> DataFrame:
    """Specified only: a text cut at numbered headings (``1 Title``, ``2.3 Title``): ``chapter_ord, chapter`` per piece."""
    return docs.select("*", F.posexplode(F.filter(F.split(text, r"\n(?=\d+(?:\.\d+)*\.?\s+\S)"), lambda c: F.btrim(c) != "")).alias("chapter_ord", "chapter"))


def docx_bytes(title: str | None, body: str | None) -> bytes:
    """A minimal Word file: a paragraph for the title and for each line. Marks that XML cannot hold become blanks."""
    from xml.sax.saxutils import escape

    lines = [_NO_XML.sub(" ", x or "") for x in (title, *(body or "").split("\n"))]
    rows = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line, {chr(13): "&#13;"})}</w:t></w:r></w:p>' for line in lines)
    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{rows}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>')
        z.writestr("word/document.xml", xml)
    return out.getvalue()


@F.arrow_udf(T.BinaryType())
def word_file(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The bytes of a Word file for each row of titles and texts."""
    for rows in in_slices(pa.StructArray.from_arrays(list(both), ["title", "body"]) for both in batches):
        yield pa.array([docx_bytes(x["title"], x["body"]) for x in rows.to_pylist()], pa.binary())


def write_docx(path: str, title: str, body: str) -> None:
    """A minimal Word file, for fixtures."""
    with open(path, "wb") as f:
        f.write(docx_bytes(title, body))
