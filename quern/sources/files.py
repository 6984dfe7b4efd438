"""Files of many formats as rows (source, text), and the choice of files."""

from __future__ import annotations

import csv
import glob
import io
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.records import rendered
from quern.sources.office import docx_text, pptx_text, xlsx_text


def pdf_text(content: bytes) -> str:
    """The text of all pages without a separator; needs a PDF library."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF needs the package pymupdf") from e
    with fitz.open(stream=content, filetype="pdf") as pdf:
        return "".join(page.get_text() for page in pdf)


def csv_text(content: bytes) -> str:
    """The table as CSV again, in plain quoting; values stay as they are written."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(r for r in csv.reader(io.StringIO(_decoded(content))) if r)
    return out.getvalue()


def _decoded(content: bytes) -> str:
    return content.decode("utf-8-sig", "replace")


READERS: dict[str, Callable[[bytes], str]] = {
    ".txt": _decoded,
    ".pdf": pdf_text,
    ".docx": docx_text,
    ".pptx": pptx_text,
    ".csv": csv_text,
    ".xls": xlsx_text,
    ".xlsx": xlsx_text,
    ".json": lambda content: rendered(_decoded(content)),
    ".jsonl": lambda content: rendered(_decoded(content)),
}


def text_of(name: str, content: bytes) -> str:
    """The text of a file by the extension of its name, in any case."""
    kind = Path(name).suffix.lower()
    if kind not in READERS:
        raise ValueError(f"no reader for files of type {kind or name!r}")
    return READERS[kind](content)


def read_files(spark: SparkSession, *paths: str, pattern: str = "*") -> DataFrame:
    """(source, text, error): a row a file, read where the file is; a file that cannot be read has its reason in ``error``.

    A file is one row, so very large line formats are better read by ``read_json_lines`` or Spark's own readers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths))

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
    def read(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for name, content in zip(names, contents, strict=True):
            try:
                out.append((text_of(name, content), None))
            except Exception as e:  # noqa: BLE001
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["text", "error"])

    return files.select(F.col("path").alias("source"), read("path", "content").alias("r")).select("source", "r.text", "r.error")


def expand(globs: str, root: str = ".") -> list[str]:
    """The files that comma-separated patterns name, sorted, each once."""
    return sorted({p for g in globs.split(",") if g.strip() for p in glob.glob(str(Path(root) / g.strip()), recursive=True)})


def only_file(folder: str, kinds: tuple[str, ...] = tuple(READERS)) -> str | None:
    """The folder's one file of a readable type; None if there is none or more than one."""
    found = [p for p in sorted(Path(folder).iterdir()) if p.is_file() and p.suffix.lower() in kinds] if Path(folder).is_dir() else []
    return str(found[0]) if len(found) == 1 else None
