"""WARC archive (operator 5): payload bytes stored once by verified digest, exact record headers apart.

An archive is two Parquet tables in one folder: ``payloads`` (digest, payload), one row for each distinct payload, and
``headers`` (record number, digest, the record's exact header bytes), one row for each record. A record's bytes are its
header, its content block and two line ends; ``records`` rebuilds them by a join on the digest, and each payload is
checked against its SHA-256 on the way. A response's block is the payload alone, without an HTTP head, as a resource
record's would be: pages come without one.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest id is a ``response``; the
others are ``revisit`` records with an empty block that refer to it. Smaller payloads are all responses. The owner of a
payload is found by a grouped maximum over digests and ids; payloads are made distinct by their digest. Both combine on
the map side, so a payload that a third of all records share reaches a reducer once from each task; payloads that occur
once aren't shuffled at all where the list of the others has a broadcast's size. Joins on digests take hot ones apart.

Defined cases: a null or empty payload has zero bytes; a null url gives no target line, and line ends in one are
percent-encoded; ties don't occur, as ids order the records of a payload; a null id loses against any
other and is kept as null (if all ids of a payload are null, all its records are responses); with repeated rows of the
largest id all of them are responses and the payload is still stored once for readers; payloads of any length are
stored whole; extra columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm.common import BROADCAST_BYTES, discard, join_counted, join_split, materialize, new_path, table

# Fixed value: the alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def base32_of_hex(hexed: Column) -> Column:
    """Base32 text of 40 hexadecimal digits (160 bits), without Python: each 5 digits are four letters."""
    parts = []
    for i in range(8):
        number = F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def _head(kind: str) -> str:
    """The first two lines of a record of this kind, always in this place."""
    return f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}"


def _header(kind: str) -> Column:
    """Header bytes of a record of this kind up to and with the empty line."""
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    # a line end in a url would begin another header line
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [F.lit(_head(kind)), line("WARC-Record-ID", urn(F.col("id"))), line("WARC-Date", F.lit(DATE)), F.coalesce(line("WARC-Target-URI", url), F.lit(""))]
    lines.append(line("WARC-Payload-Digest", F.lit("sha1:"), F.col("sha1")))
    if kind == "revisit":
        lines += [line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("owner"))), line("Content-Length", F.lit("0"))]
    else:
        lines += [line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("n_bytes").cast("string"))]
    return F.concat(*lines, F.lit(CRLF))


def write(pages: DataFrame, path: str, least_bytes: int = 0, key: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record for each row of ``pages`` to the archive in folder ``path``."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    spark = pages.sparkSession
    facts = rows.select("id", "url", F.unhex(F.sha2("payload", 256)).alias("digest"), F.sha1("payload").alias("sha1_hex"), F.length("payload").cast("long").alias("n_bytes"))
    facts = materialize(facts, "page-facts")
    owners = facts.groupBy("digest").agg(F.max("id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(owners, "owners")
    # a digest that many records share is joined apart; only digests, ids and urls move here
    known = join_counted(facts, shared, ["digest"], facts.count(), how="left")
    revisit = F.col("owner").isNotNull() & (F.col("n_bytes") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("owner"))
    known = known.withColumn("sha1", base32_of_hex(F.col("sha1_hex")))
    header = F.when(revisit, _header("revisit")).otherwise(_header("response")).cast("binary")
    known.select("id", "digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    once = rows.select(F.unhex(F.sha2("payload", 256)).alias("digest"), "payload")
    several = shared.select("digest")
    if several.count() * 48 <= BROADCAST_BYTES:  # then what occurs once needs no shuffle
        names = F.broadcast(several)
        once = once.join(names, "digest", "left_anti").unionByName(once.join(names, "digest", "left_semi").dropDuplicates(["digest"]))
    else:
        once = once.dropDuplicates(["digest"])
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")
    discard(facts, shared)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(digest, header, payload, record, intact, n_bytes, sha1_hex) of every record, rebuilt: a response's block is its
    payload, a revisit's is empty and so is its ``payload`` here.

    Size and digests are taken from the stored bytes, once for each payload; ``intact`` says whether they still have their
    digest. Responses meet the bytes; revisits, of which one payload may have very many, meet these few facts only.
    """
    headers = spark.read.schema("id long, digest binary, header binary").parquet(f"{path}/headers")
    stored = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    measured = stored.select("digest", "payload", (F.unhex(F.sha2("payload", 256)) == F.col("digest")).alias("intact"), F.length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("sha1_hex"))
    is_revisit = F.col("header").startswith(F.lit(_head("revisit").encode()))
    end = F.lit(CRLF * 2).cast("binary")
    answered = join_split(headers.where(~is_revisit), measured, ["digest"], "left")
    answered = answered.withColumn("record", F.concat("header", "payload", end))
    again = headers.where(is_revisit)
    counts = again.groupBy("digest").agg(F.count("*").alias("n"))
    told = materialize(measured.drop("payload").join(counts, "digest"), "payload-facts")
    total = told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    again = join_counted(again, told, ["digest"], total, how="left", row_bytes=F.lit(160)).withColumns({"payload": F.lit(None).cast("binary"), "record": F.concat("header", end)})
    columns = ["digest", "header", "payload", "record", "intact", "n_bytes", "sha1_hex"]
    return answered.select(*columns).unionByName(again.select(*columns))


def field(header: Column, name: str) -> Column:
    """A header field's value, or null."""
    found = F.regexp_extract(header.cast("string"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def facts(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read from rebuilt records; the payload's size and
    SHA-1, taken from its stored bytes, are compared with what the header says (``agrees``)."""
    id_of = lambda name: F.expr(f"try_cast(regexp_extract(cast(header as string), '{name}: <urn:record:(-?[0-9]+)>', 1) as bigint)")
    digest = base32_of_hex(F.col("sha1_hex"))
    kind = field(F.col("header"), "WARC-Type")
    agrees = F.col("intact") & (field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)) & (F.length("record") == F.length("header") + 4 + field(F.col("header"), "Content-Length").cast("long"))
    columns = [id_of("WARC-Record-ID").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), digest.alias("payload_digest"), kind.alias("record_type")]
    return found.select(*columns, id_of("WARC-Refers-To").alias("refers_to"), agrees.alias("agrees"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return facts(records(spark, path))
