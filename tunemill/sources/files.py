"""Readers of definition XML, INI, markdown, EPUB, JSON lines and binary images, and the registry of sources."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunemill.session import small

_ROM = "romid struct<xmlid:string,ecuid:string,make:string,model:string,submodel:string,year:string,market:string,transmission:string,memmodel:string,flashmethod:string>, include array<string>, table array<struct<_name:string>>"


def rom_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, title, text, tables, includes): one document for each definition with an identity; bad files are left out."""
    rows = spark.read.format("xml").option("rowTag", "rom").option("mode", "DROPMALFORMED").schema(_ROM).load(path).where("romid is not null")
    names = F.filter(F.transform(F.coalesce("table", F.array().cast("array<struct<_name:string>>")), lambda t: t["_name"]), lambda n: n.isNotNull())
    fields = ["ecuid", "year", "market", "transmission", "memmodel", "flashmethod"]
    title = F.concat_ws(" ", F.coalesce("romid.make", F.lit("Subaru")), "romid.model", "romid.submodel", "romid.year", F.concat(F.lit("("), "romid.xmlid", F.lit(")")))
    identity = F.concat_ws("\n", *(F.concat(F.lit(f"  {f}: "), F.col(f"romid.{f}")) for f in fields))
    text = F.concat_ws("\n", title, F.lit(""), F.lit("ROM identity:"), identity, F.lit(""), F.format_string("Tunable tables (%d):", F.size(names)), F.array_join(F.transform(names, lambda n: F.concat(F.lit("  - "), n)), "\n"))
    return rows.select(F.trim("romid.xmlid").alias("source_id"), title.alias("title"), text.alias("text"), names.alias("tables"), F.coalesce("include", F.array().cast("array<string>")).alias("includes"))


_CONVERSION = "conversions struct<conversion:array<struct<_units:string,_expr:string>>>"


def logger_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, title, text, units, ecus): standard and ECU-specific parameters of a logger definition."""
    def read(tag: str, more: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(f"_id string, _name string, _desc string, {_CONVERSION}{more}").load(path).where("_id is not null and _name is not null")

    conv = F.coalesce("conversions.conversion", F.array().cast("array<struct<_units:string,_expr:string>>"))
    units = F.array_distinct(F.filter(F.transform(conv, lambda c: c["_units"]), lambda u: u.isNotNull()))
    exprs = F.transform(F.filter(conv, lambda c: c["_expr"].isNotNull()), lambda c: F.concat(F.coalesce(c["_units"], F.lit("?")), F.lit(": "), c["_expr"]))

    def document(rows: DataFrame, kind: str, address, ecus) -> DataFrame:
        text = F.concat_ws(
            "\n",
            F.concat(F.lit(f"{kind}: "), "_name"),
            F.concat(F.lit("  id: "), "_id"),
            F.concat(F.lit("  units: "), F.when(F.size(units) > 0, F.array_join(units, ", ")).otherwise("(none)")),
            F.concat(F.lit("  supported ECUs: "), ecus.cast("string")),
            F.concat(F.lit("  description: "), "_desc"),
            F.concat(F.lit("  address: "), address),
            F.when(F.size(exprs) > 0, F.concat(F.lit("  conversion(s): "), F.array_join(exprs, "; "))),
        )
        return rows.select(F.col("_id").alias("source_id"), F.col("_name").alias("title"), text.alias("text"), units.alias("units"), ecus.alias("ecus"))

    standard = document(read("parameter", ", address string"), "Loggable parameter", F.trim("address"), F.lit(None).cast("int"))
    specific = read("ecuparam", ", ecu array<struct<_id:string>>")
    return standard.unionByName(document(specific, "ECU-specific loggable parameter", F.lit(None).cast("string"), F.coalesce(F.size("ecu"), F.lit(0))))


def rom_ids(spark: SparkSession, path: str) -> DataFrame:
    """Only the identities of a large definition file."""
    return spark.read.format("xml").option("rowTag", "romid").schema("xmlid string, ecuid string, make string, model string, year string").load(path)


def markdown(spark: SparkSession, path: str, min_chars: int = 200) -> DataFrame:
    """(url, title, text): a document for each file; the title is its first top heading or its name."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("text"))
    stem = F.regexp_extract("url", r"([^/]+)\.md$", 1)
    title = F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^\s*# (.*)$", 1), F.lit("")), stem)
    return rows.where(~F.contains("url", F.lit("/.git/")) & (F.length("text") >= min_chars)).select("url", F.trim(title).alias("title"), "text")


_HEAD = {"table": re.compile(r'^\s*table\s*=\s*(\w+)\s*,\s*\w+\s*,\s*"([^"]*)"'), "curve": re.compile(r'^\s*curve\s*=\s*(\w+)\s*,\s*"([^"]*)"')}


def ini_blocks(text: str) -> list[dict[str, Any]]:
    """The table and curve blocks of an INI, with what they bind to each axis."""
    out: list[dict[str, Any]] = []
    section, block = "", None
    for line in text.splitlines():
        if m := re.match(r"^\s*\[(\w+)\]", line):
            section, block = m.group(1), None
        elif section in ("TableEditor", "CurveEditor"):
            head = next(((k, m) for k, p in _HEAD.items() if (m := p.match(line))), None)
            if head:
                block = {"kind": head[0], "name": head[1].group(1), "title": head[1].group(2), "section": section, "lines": [line.strip()], "bins": {}}
                out.append(block)
            elif block is not None and line.strip():
                block["lines"].append(line.strip())
                if b := re.match(r"^\s*([xyz]Bins)\s*=\s*([\w,\s]+)", line):
                    block["bins"][b.group(1)] = b.group(2).strip()
    return out


def ini_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(url, source_id, title, text, bins): a document for each block of each INI file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.ini").select(F.col("_metadata.file_path").alias("url"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = [(u, f"{b['kind']}:{b['name']}", b["title"] or b["name"], "\n".join([f"{b['kind']} definition: {b['title']}", f"ini name: {b['name']}", f"section: [{b['section']}]", "", *b["lines"]]), b["bins"]) for u, t in zip(files["url"], files["value"]) for b in ini_blocks(t)]
            yield pd.DataFrame(rows, columns=["url", "source_id", "title", "text", "bins"])

    return files.mapInPandas(run, "url string, source_id string, title string, text string, bins map<string,string>")


def epub_chapters(data: bytes) -> list[tuple[int, str, str]]:
    """(index, title, text) of the chapters of an EPUB in reading order."""
    import io
    import posixpath
    import zipfile
    from xml.etree import ElementTree

    from tunemill.sources.markup import clean

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(x.get("full-path") for x in container.iter() if x.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
        items = {x.get("id"): x.get("href") for x in package.iter() if x.tag.endswith("}item")}
        order = [items[x.get("idref")] for x in package.iter() if x.tag.endswith("}itemref") and x.get("idref") in items]
        out = []
        for i, href in enumerate(order):
            title, text = clean(z.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf), href))).decode("utf-8", "replace"))
            out.append((i, title, text))
    return out


def books(spark: SparkSession, path: str, min_chars: int = 80) -> DataFrame:
    """(url, source_id, title, text, error): a document for each chapter of an EPUB and for each page of a PDF.

    A file that can't be read gives one row with its error and no text. Where there are PDFs, pypdf must be installed: the
    workers fail without it, as every PDF would be lost.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(epub|pdf)$")).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for files in batches:
            rows = []
            for url, data in zip(files["path"], files["content"]):
                name, is_pdf = url.rsplit("/", 1)[-1], url.lower().endswith(".pdf")
                if is_pdf:
                    from pypdf import PdfReader
                try:
                    if is_pdf:
                        rows += [(url, f"{name}#p{i + 1}", name, page.extract_text() or "", None) for i, page in enumerate(PdfReader(io.BytesIO(data)).pages)]
                    else:
                        rows += [(url, f"{name}#c{i}", title or name, text, None) for i, title, text in epub_chapters(data)]
                except Exception as e:  # a bad file never ends the pass
                    rows.append((url, name, name, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["url", "source_id", "title", "text", "error"])

    return files.mapInPandas(run, "url string, source_id string, title string, text string, error string").where((F.length("text") >= min_chars) | F.col("error").isNotNull())


def json_lines(spark: SparkSession, path: str, schema: str, broken: str | None = None) -> DataFrame:
    """Rows of JSON lines; blank lines are none. Broken lines are left out, or kept as they are in the column `broken`."""
    if broken is None:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return spark.read.schema(f"{schema}, `{broken}` string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken).json(path)


def newest_per_tag(spark: SparkSession, path: str, schema: str, tag: str) -> DataFrame:
    """The rows of the last file, by name, of each tag; a file's tag is what the pattern captures in its name.

    Names are those under path; a folder of part files is one file by the folder's name.
    """
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    under = F.regexp_extract(F.url_decode("_metadata.file_path"), "/" + re.escape(path.rstrip("/").rsplit("/", 1)[-1]) + "/(?:(.+)/[^/]+|([^/]+))$", 1)
    rows = rows.withColumn("_file", F.coalesce(F.nullif(under, F.lit("")), F.col("_metadata.file_name"))).withColumn("tag", F.regexp_extract("_file", tag, 1))
    last = rows.groupBy("tag").agg(F.max("_file").alias("_file"))
    return rows.join(small(last), ["tag", "_file"])


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha1, content) of binary files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha1("content").alias("sha1"), "content")


def new_attachments(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """found(attachment_id, name, content) that the manifest doesn't know, with what they are."""
    from tunemill.functions.text import is_markup, rom_id
    from tunemill.sources.markup import is_image_name

    rows = found.join(manifest.select("attachment_id").distinct(), "attachment_id", "left_anti").where(is_image_name(F.col("name")))
    return rows.select("attachment_id", "name", F.sha1("content").alias("sha1"), rom_id(F.col("name")).alias("rom_id"), F.when(is_markup(F.col("content")), "blocked").otherwise("ok").alias("state"))


#: What each registered source reads; a source is a function of (session, path).
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rom_defs": rom_definitions,
    "logger_defs": logger_parameters,
    "markdown": markdown,
    "ini_defs": ini_definitions,
    "books": books,
    "images": images,
}


def register(name: str, read: Callable[[SparkSession, str], DataFrame]) -> None:
    REGISTRY[name] = read


def fetch(spark: SparkSession, name: str, path: str) -> DataFrame:
    return REGISTRY[name](spark, path).withColumn("source", F.lit(name))


def retryable(status):
    """Is a response worth another try? (column of status codes; null is a timeout)"""
    return status.isNull() | (status == 429) | (status >= 500)
