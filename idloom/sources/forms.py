"""Uploaded forms: a file and its text fields in one multipart body, as bodies are dropped into a folder.

A body is one file of the folder, so file and fields can't be torn apart or paired wrongly, and Spark's file source gives
each once, also after a restart from the checkpoint.

Defined cases: of fields with one name the last counts; a form without a file has a null image; bodies that break a limit or
aren't a form keep their path and have a problem and nothing else. The type is told by the file's first bytes, not by what
the form says.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.sources.files import media_type

# The greatest sizes of a body and of its file, and the most files and fields.
BODY_BYTES, FILE_BYTES, FILES, FIELDS = 13 << 20, 12 << 20, 1, 8

_DISPOSITION = re.compile(rb"(?im)^content-disposition:\s*form-data\s*(;.*?)\r?$")
_NAMED = re.compile(rb';\s*(name|filename)="([^"]*)"', re.IGNORECASE)


class _Wrong(Exception):
    """A body that isn't taken; the message says why."""


def parse_form(body: bytes, file_bytes: int = FILE_BYTES) -> tuple[dict[str, str], str | None, bytes | None]:
    """(fields, file name, file) of a multipart body, whose first line is its boundary."""
    line = body.partition(b"\r\n")[0]
    if not line.startswith(b"--") or not 2 < len(line) <= 72:
        raise _Wrong("malformed")
    boundary = line[2:]
    if b"\r\n--" + boundary + b"--" not in body and not body.startswith(b"--" + boundary + b"--"):
        raise _Wrong("malformed")
    inside = body[len(line) :].partition(b"\r\n--" + boundary + b"--")[0]
    fields: dict[str, str] = {}
    name_of_file, file, files, texts = None, None, 0, 0
    for part in inside.split(b"\r\n--" + boundary):
        head, found, data = part.removeprefix(b"\r\n").partition(b"\r\n\r\n")
        said = {k.lower(): v.decode("utf-8", "replace") for k, v in _NAMED.findall(b";".join(_DISPOSITION.findall(head)))}
        if not found or b"name" not in said:
            raise _Wrong("malformed")
        if b"filename" in said:
            files += 1
            name_of_file, file = said[b"filename"], data
        else:
            texts += 1
            fields[said[b"name"]] = data.decode("utf-8", "replace")
    if files > FILES:
        raise _Wrong("too_many_files")
    if texts > FIELDS:
        raise _Wrong("too_many_fields")
    if file is not None and len(file) > file_bytes:
        raise _Wrong("file_too_large")
    return fields, name_of_file, file


def read_forms(bodies: DataFrame, body_bytes: int = BODY_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(path, fields, file_name, image, media_type, problem) of bodies (path, content), at rest or in a stream."""
    schema = "path string, fields map<string,string>, file_name string, image binary, problem string"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one body at a time: they are large
                fields, name, file, problem = None, None, None, None
                try:
                    body = batch.column(1)[i].as_py()
                    if body is None or len(body) > body_bytes:
                        raise _Wrong("malformed" if body is None else "body_too_large")
                    fields, name, file = parse_form(body, file_bytes)
                except _Wrong as wrong:
                    problem = str(wrong)
                row = [[fields and list(fields.items())], [name], [file], [problem]]
                kinds = (pa.map_(pa.string(), pa.string()), pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array(v, k) for v, k in zip(row, kinds, strict=True))], names=["path", "fields", "file_name", "image", "problem"])

    rows = bodies.select("path", "content").mapInArrow(run, schema)
    return rows.select("path", "fields", "file_name", "image", media_type(F.col("image")).alias("media_type"), "problem")


def form_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """The forms that are dropped into a folder, each once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return read_forms(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).load(folder))
