"""Billing exports as CSV files, and their ingestion.

``write_exports`` turns the canonical billing rows into CSV exports, one
upload per tenant, in the header layout of the tenant's billing source (by the
first letter of the tenant name; unknown letters use the plain layout). They
look as uploads do: extra columns, quoted fields with commas, quotes and line
breaks, blank first lines, copies, padded ids, amounts with units, short and long lines, missing-value spellings, three date spellings, UTF-8 with and
without a byte order mark and two single-byte encodings. They land under the
shared checkpoint folder, so on a cluster every executor sees them.

``ingest`` does what the upload flow does, with any number of files at once:
a file is read whole by one task (it is at most as large as an upload may be),
which finds its records, encoding and header and cuts records into fields by
position of that header, and fields get their canonical names by the mapping of that header. Columns
that no field claims pass through in ``extras`` (name and value, in order).

Defined cases: blank lines (before the header too) are skipped; a short record
is padded with NULL; a record with more fields than its header is dropped (the
strict read refuses its whole file); a default missing-value spelling is NULL; a
quoted field may hold commas, quotes and line breaks (``records.py``). Files
without a record, with a header only, that end within quotes or are larger than
the limit give no rows and are reported.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.functions import columns as C
from recurra.functions.constants import MAX_FILE_BYTES, PANDAS_NA_STRINGS, PRESET_SIGNATURES
from recurra.session import materialize, shared_path
from recurra.sources import records as R

CANONICAL = ["customer_id", "date", "amount", "status", "currency"]
#: Columns beside the canonical ones that every export carries.
EXTRAS = {"src_order": "order_ref", "src_line": "line_no", "memo": "memo"}
CUSTOM = {"customer_id": "Client ID", "date": "Billing Date", "amount": "Plan Amount", "status": "Subscription Status",
          "currency": "Currency Code", "created_by": "Created By"}


def _layouts() -> dict[str, dict[str, str]]:
    """Header names per billing source: the presets' signatures, and a header only the fuzzy matcher maps."""
    out = {name: {f: sig[f] for f in CANONICAL if f in sig} | {"currency": "currency"}
           for name, sig in PRESET_SIGNATURES if name != "gumroad"}
    out["custom"] = CUSTOM
    return {name: header | EXTRAS for name, header in out.items()}


LAYOUTS = _layouts()
LAYOUT_BY_INITIAL = {"A": "stripe", "B": "paddle", "F": "lemonsqueezy", "H": "chargebee", "M": "custom"}
#: How a source writes dates; others write yyyy-MM-dd.
DATE_FORMATS = {"stripe": "MM/dd/yyyy", "lemonsqueezy": "dd/MM/yyyy"}
#: Sources whose files are not UTF-8, and the memo that shows it (the second one is no valid cp1251).
SINGLE_BYTE = {"chargebee": "Счёт", "lemonsqueezy": "Café\u0098"}
BOM_LAYOUT = "paddle"
#: Sources whose exports hold lines with too many fields.
LONG_LINE_LAYOUTS = ["stripe", "custom"]
#: Orders per file: an export of a large tenant is many files.
CHUNK_ORDERS = 100_000
#: Export files that one task writes side by side; more are sorted by file first.
OPEN_FILES = 256

_HIGH = [chr(b) for b in range(0x80, 0x100)]
_CP1251 = [(c, bytes([ord(c)]).decode("cp1251")) for c in _HIGH if c != "\x98"]  # 0x98 has no meaning there
_LATIN, _CYRILLIC = "".join(a for a, _ in _CP1251), "".join(b for _, b in _CP1251)


def layout_of(tenant: Column) -> Column:
    m = F.create_map(*[x for k, v in LAYOUT_BY_INITIAL.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.upper(F.substring(tenant, 1, 1))), F.lit("manual"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _csv_field(v: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(v.contains('"') | v.contains(",") | v.contains("\r") | v.contains("\n"), quoted).otherwise(v)


def export_records(raw: DataFrame) -> DataFrame:
    """(tenant_id, layout, chunk, src_order, src_line, copy, record): the records of the exports, of one or more lines.

    Order and line number do not tell records apart, so their text orders them too. As in real exports some records are there twice, some a second time with another spelling of the status; ids
    carry blanks, amounts units, single dates another format than their file's, and memos line breaks.
    """
    rows = raw.withColumn("layout", layout_of(F.col("tenant_id")))
    if "chunk" not in raw.columns:
        rows = rows.withColumn("chunk", F.floor(F.col("src_order") / CHUNK_ORDERS))
    twice = (F.col("src_line") == 6) & (F.col("src_order") % 5 == 0)
    respelled = (F.col("src_line") == 7) & (F.col("src_order") % 5 == 1) & (F.col("status") == "Active")
    rows = rows.withColumn("copy", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).when(
        respelled, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))))
    foreign = F.create_map(*[x for k, v in SINGLE_BYTE.items() for x in (F.lit(k), F.lit(v))])
    word = F.coalesce(F.element_at(foreign, F.col("layout")), F.lit("Facture é"))
    memo = (F.when(F.col("src_line") == 1, F.concat(word, F.lit(', "'), F.col("status"), F.lit('", 1')))
             .when(F.col("src_line") == 2, F.lit("NA"))
             .when(F.col("src_line") == 3, F.concat(word, F.lit('\nline 2, "x"\n \nend'))).otherwise(word))
    fmt = F.create_map(*[x for k, v in DATE_FORMATS.items() for x in (F.lit(k), F.lit(v))])
    usual = F.coalesce(F.element_at(fmt, F.col("layout")), F.lit("yyyy-MM-dd"))
    other = (F.col("src_line") == 3) & (F.col("src_order") % 9 == 0)
    used = F.when(other, F.when(usual == "yyyy-MM-dd", "MM/dd/yyyy").otherwise("yyyy-MM-dd")).otherwise(usual)
    spelled = F.when(used == "MM/dd/yyyy", F.date_format("date", "MM/dd/yyyy")).when(
        used == "dd/MM/yyyy", F.date_format("date", "dd/MM/yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    amount = F.format_string("%.2f", F.col("amount"))
    amount = F.when((F.col("src_line") == 1) & (F.col("src_order") % 11 == 0), F.concat(F.lit("$"), amount)).when(
        (F.col("src_line") == 1) & (F.col("src_order") % 13 == 0), F.concat(amount, F.lit("d"))).otherwise(amount)
    padded = (F.col("src_line") == 2) & (F.col("src_order") % 3 == 0)
    value = {"customer_id": F.when(padded, F.concat(F.lit("  "), "customer_id", F.lit(" \u00a0"))).otherwise(F.col("customer_id")),
             "date": spelled, "amount": amount,
             "status": F.when(F.col("copy") == 2, "active").otherwise(F.col("status")), "currency": F.col("currency"),
             "src_order": F.col("src_order").cast("string"), "src_line": F.col("src_line").cast("string"), "memo": memo}
    short = (F.col("src_line") == 4) & (F.col("src_order") % 3 == 0)  # the last field is left out
    long = F.col("layout").isin(LONG_LINE_LAYOUTS) & (F.col("src_line") == 5) & (F.col("src_order") % 4 == 0)

    # Cells are made once and then joined: all layouts have the same fields in the same order, but for one of the custom one.
    def cells(fields):
        return F.array(*[F.coalesce(_csv_field(value[f]), F.lit("")) for f in fields])

    none = F.array().cast("array<string>")
    rows = rows.select("tenant_id", "layout", "chunk", "src_order", "src_line", "copy", short.alias("short"), long.alias("long"),
                       cells(CANONICAL).alias("known"), cells(EXTRAS).alias("rest"))
    every = F.concat("known", F.when(F.col("layout") == "custom", F.array(F.lit("export"))).otherwise(none), "rest",
                     F.when(F.col("long"), F.array(F.lit("surplus"), F.lit("fields"))).otherwise(none))
    rows = rows.withColumn("cells", every)
    text = F.array_join(F.slice("cells", 1, F.size("cells") - F.col("short").cast("int")), ",")
    return rows.select("tenant_id", "layout", "chunk", "src_order", "src_line", "copy", text.alias("record"))


def write_exports(spark: SparkSession, raw: DataFrame, path: str) -> None:
    """<path>/charset=<c>/tenant_id=<t>/chunk=<k>/*.csv, each with its header, lines in file order.

    The facts are shuffled once, by file; their text is made behind the shuffle and
    written in one pass, in one character per byte whatever the encoding. A file is
    one (tenant, chunk), so a large tenant is spread over many tasks. Exports of a
    custom layout begin with blank lines. Beside them lie the files that an upload
    must refuse.
    """
    placed = raw.withColumn("chunk", F.floor(F.col("src_order") / CHUNK_ORDERS)).repartition("tenant_id", "chunk")
    records = export_records(placed)
    headers = F.create_map(*[x for name, h in LAYOUTS.items() for x in (
        F.lit(name), F.lit(("\ufeff" if name == BOM_LAYOUT else "") + ",".join(h.values())))])
    header = F.element_at(headers, F.col("layout"))
    first = F.when(F.col("layout") == "custom", F.array(F.lit(" \t"), F.lit("  "), header)).otherwise(F.array(header))
    at = F.row_number().over(Window.partitionBy("tenant_id", "chunk").orderBy("src_order", "src_line", "copy", "record"))
    body = F.split("record", "\n")
    lines = records.withColumn("place", at).select(
        "tenant_id", "layout", "chunk", F.explode(F.when(F.col("place") == 1, F.concat(first, body)).otherwise(body)).alias("line"))
    # Letters of the single-byte code page are written as the characters that have their bytes, others as those of their UTF-8 bytes.
    utf8 = F.decode(F.encode("line", "UTF-8"), "ISO-8859-1")
    text = F.when(_is_ascii(F.col("line")) | F.col("layout").isin([x for x in SINGLE_BYTE if x != "chargebee"]), F.col("line")).when(
        F.col("layout") == "chargebee", F.translate("line", _CYRILLIC, _LATIN)).otherwise(utf8)
    charset = F.when(F.col("layout").isin(list(SINGLE_BYTE)), "ISO-8859-1").otherwise("UTF-8")
    # A task has its lines in file order; with its files open side by side they are not sorted by file once more, which
    # would mix the lines of a file when the sort spills.
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers, None)
    spark.conf.set(writers, str(OPEN_FILES))
    try:
        (lines.select(charset.alias("charset"), "tenant_id", "chunk", text.alias("line"))
              .write.mode("overwrite").partitionBy("charset", "tenant_id", "chunk")
              .option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "\u0000").option("escapeQuotes", False)
              .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
              .csv(path))
    finally:
        spark.conf.unset(writers) if before is None else spark.conf.set(writers, before)
    head = ",".join(LAYOUTS["manual"].values()).encode() + b"\n"
    for name, content in REFUSED.items():
        tenant, file = name.split("/")
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/charset=UTF-8/tenant_id={tenant}/chunk=0/{file}")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        for _ in range(MAX_FILE_BYTES // len(FILLER) + 1 if content is None else 0):
            out.write(bytearray(FILLER))
        out.write(bytearray(b"" if content is None else content.replace(b"HEAD\n", head)))
        out.close()


#: Files no upload takes, by the reason; the one without content is longer than any file may be.
FILLER = b"customer,date\n" * 65536
REFUSED = {"r-empty/a.csv": b"", "r-note/a.txt": b"HEAD\n1,2024-01-02,1.00,Active,USD,1,1,x\n", "r-large/a.csv": None,
           "r-blank/a.csv": b"\n  \n", "r-header/a.csv": b"\nHEAD\n\n", "r-open/a.csv": b'HEAD\n1,2024-01-02,1.00,Active,USD,1,1,"never\nclosed\n'}


def ensure_exports(spark: SparkSession, identity: tuple, raw: DataFrame) -> str:
    """Write the exports once per input (``identity``: its files' paths, lengths and times)."""
    key = hashlib.sha1(repr(identity).encode()).hexdigest()[:12]
    path = shared_path(spark, f"exports-{key}")
    if not _exists(spark, f"{path}/_READY"):
        write_exports(spark, raw, path)
        spark.createDataFrame([("ok",)], "s string").coalesce(1).write.mode("overwrite").text(f"{path}/_READY")
    return path


def _empty_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for folder in fs.globStatus(at) or []:
        listed = fs.listFiles(folder.getPath(), True)
        while listed.hasNext():
            f = listed.next()
            name = f.getPath().getName()
            if f.getLen() == 0 and not name.startswith(("_", ".")):
                out.append((f.getPath().toString(), 0))
    return out


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Every file with the upload guards (.csv, non-empty, <= 15 MB).

    Only path and length are selected, so file contents are not read. Spark's
    readers pass over files without bytes; those are taken from the listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.union(spark.createDataFrame(_empty_files(spark, path), "path string, length long"))
    reason = (F.when(~F.lower(F.col("path")).endswith(".csv"), F.lit("not_csv"))
               .when(F.col("length") == 0, F.lit("empty"))
               .when(F.col("length") > MAX_FILE_BYTES, F.lit("too_large")))
    return files.select("path", "length", reason.alias("reject_reason"), reason.isNull().alias("accepted"))


def upload_of(path: Column) -> list[Column]:
    """Tenant and chunk of an export file, from its path."""
    return [F.url_decode(F.regexp_extract(path, "tenant_id=([^/]*)/", 1)).alias("tenant_id"),
            F.regexp_extract(path, "chunk=([0-9]+)/", 1).cast("long").alias("chunk")]


_FIELDS = r',("(?:[^"]++|"")*+"[^,]*|[^,]*)'


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _cells(text: Column, encoding: Column) -> Column:
    """The fields of a CSV line, unquoted and those of a cp1251 file decoded; a line without a quote is cut at its commas."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(_FIELDS), F.lit(1))
    unquoted = F.transform(raw, lambda f: F.when(
        f.startswith('"') & (F.length(f) > 1),
        F.replace(F.regexp_replace(f, r'(?s)^"((?:[^"]++|"")*+)"(.*)$', "$1$2"), F.lit('""'), F.lit('"'))).otherwise(f))
    cells = F.when(text.contains('"'), unquoted).otherwise(F.split(text, ","))
    cyrillic = F.transform(cells, lambda f: F.when(_is_ascii(f), f).otherwise(F.translate(f, _LATIN, _CYRILLIC)))
    return F.when((encoding == "cp1251") & ~_is_ascii(text), cyrillic).otherwise(cells)


def _n_cells(text: Column) -> Column:
    """The number of fields of a CSV line in any encoding, without its fields."""
    return F.when(text.contains('"'), F.regexp_count(F.concat(F.lit(","), text), F.lit(_FIELDS))).otherwise(
        F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) + 1)


class Uploads:
    """The records of all CSV files under a folder, and what is known of each file.

    No file is larger than an upload may be, so a file's records are found in the task that reads it
    (``records.read_files``) and know their file's header and encoding there; nothing is shuffled. What is
    known of the files is stored, one row each.
    """

    def __init__(self, spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES):
        self.path, self.max_bytes = path, max_bytes
        self._read = R.read_files(spark, path, max_bytes)
        self._read = self._read.withColumn("names", _cells(F.get("records", F.lit(0)), F.col("encoding")))
        self._read = self._read.withColumn("header_id", F.md5(F.to_json("names")))
        self.about = materialize(spark, self._read.select(
            "file", "encoding", "bom", "names", "unclosed", F.size("records").alias("n_records"), "header_id"), "upload-files")
        self.files = self.about.where("n_records > 1")

    def rejects(self) -> DataFrame:
        """Files that pass the guards of ``file_manifest`` and cannot be read: (file, reject_reason)."""
        reason = F.when(F.col("unclosed"), "unclosed_quote").when(F.col("n_records") == 0, "no_columns").when(F.col("n_records") == 1, "no_rows")
        return self.about.select("file", reason.alias("reject_reason")).where("reject_reason IS NOT NULL")

    def encodings(self) -> DataFrame:
        """(file, encoding, encoding_warning): the chain utf-8-sig, utf-8, cp1251, latin-1 over the whole file."""
        return self.files.select("file", F.when(F.col("bom") & (F.col("encoding") == "utf-8"), "utf-8-sig").otherwise(F.col("encoding")).alias("encoding"),
                                 (F.col("encoding") == "latin-1").alias("encoding_warning"))

    def catalog(self, source: Column | None = None) -> DataFrame:
        """(source_id, ordinal, column) of the distinct headers, or of the sources that ``source`` names."""
        source = F.col("header_id") if source is None else source
        return self.files.select(source.alias("source_id"), F.posexplode("names").alias("ordinal", "column")).distinct()

    def rows(self, strict: bool = False) -> DataFrame:
        """(file, at, encoding, header_id, cells) of the data records; ``strict`` leaves out files with a long one."""
        # Outer, as otherwise a condition on the array's size would find all records of a file once more, before they are read.
        each = self._read.select("file", "encoding", "header_id", F.size("names").alias("width"), F.posexplode_outer("records").alias("at", "text")).where("at > 0")
        # The fields are counted on the text: a condition on the cells would cut each record once more.
        long = _n_cells(F.col("text")) > F.col("width")
        r = each.where(~long).select("file", "at", "encoding", "header_id", _cells(F.col("text"), F.col("encoding")).alias("cells"))
        if strict:
            refused = materialize(r.sparkSession, each.where(long).select("file").distinct(), "upload-long")
            r = r.join(refused, "file", "left_anti")
        return r


def ingest(spark: SparkSession, path: str, strict: bool = False, uploads: Uploads | None = None,
           mapping: DataFrame | None = None, store: bool = True) -> DataFrame:
    """R1 + M7: (tenant_id, canonical fields as text, extras, file, ordinal, encoding_warning) of every file's rows.

    ``ordinal`` orders the rows of a file; cleaning takes the first of equal rows and the first date by it.

    ``mapping`` (source_id = header_id, field, column) replaces the resolved
    one. A header maps at most five fields, so each header's map is one row,
    stored, which the rows meet. The rows are stored too: each file is parsed once
    however often they are read (``store=False``: each time, for those that read them once).
    """
    from recurra.operators import mapping as M
    uploads = uploads or Uploads(spark, path)
    heads = materialize(spark, uploads.files.select("header_id", "names").distinct(), "upload-heads")
    catalog = heads.select(F.col("header_id").alias("source_id"), F.posexplode("names").alias("ordinal", "column"))
    resolved = M.resolve_mapping(catalog) if mapping is None else mapping
    places = (resolved.select("source_id", "field", "column").join(catalog, ["source_id", "column"])
              .groupBy("source_id", "field").agg(F.min("ordinal").alias("ordinal"))
              .groupBy(F.col("source_id").alias("header_id")).agg(
                  F.map_from_entries(F.collect_list(F.struct("field", "ordinal"))).alias("at")))
    at = F.coalesce("at", F.create_map().cast("map<string,int>"))
    named = F.transform("names", lambda n, i: F.struct(n.alias("name"), i.alias("i")))
    # One column per field (-1: none), so that a row takes its fields by number.
    places = heads.join(places, "header_id", "left").select(
        "header_id", *[F.coalesce(F.try_element_at(at, F.lit(f)), F.lit(-1)).alias(f"at_{f}") for f in CANONICAL],
        F.filter(named, lambda p: ~F.array_contains(F.map_values(at), p["i"])).alias("free"))
    rows = uploads.rows(strict).withColumnRenamed("at", "ordinal").join(materialize(spark, places, "upload-places"), "header_id", "left")
    fields = [C.null_if_na_string(F.get("cells", F.col(f"at_{f}"))).alias(f) for f in CANONICAL]
    extras = F.transform("free", lambda p: F.struct(p["name"].alias("name"), C.null_if_na_string(F.get("cells", p["i"])).alias("value")))
    rows = rows.select(upload_of(F.col("file"))[0], *fields, extras.alias("extras"), "file", "ordinal",
                       (F.col("encoding") == "latin-1").alias("encoding_warning"))
    return materialize(spark, rows, "ingested", "zstd") if store else rows


def extra(name: str) -> Column:
    """The value of a pass-through column."""
    return F.get(F.filter("extras", lambda e: e["name"] == name), F.lit(0))["value"]
